"""Languages of documents and paragraphs by hyperdimensional letter profiles."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Usual spellings of each language: two-letter code, three-letter codes, English name. Fixed values.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pt": ("pt", "por", "portuguese"),
}
#: Bound of the sample that the prototypes are bundled from.
SAMPLE_ROWS = 5_000
#: Words whose vectors a task keeps, words that are bundled and documents that are judged at once.
WORD_VECTORS, AT_ONCE, DOCUMENTS_AT_ONCE = 12_000, 256, 100
#: Letters of the longest word whose vector is kept in 16 bits.
KEPT_LETTERS = 40
#: Cosine to the nearest prototype below which a text is in none of the languages.
STRANGE = 0.06
#: Words that a paragraph as a whole counts for in the comparison of each of its clauses.
PARAGRAPH = 10.0
_LINE = re.compile(r"\r\n|\r|\n|\x0b|\x0c|\x85| | ")
_CLAUSE = re.compile(r"(?<=[.!?;:,])\s+|(?<=[.!?])(?=[A-ZÀ-Þ])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")


def spelled(label: str | None) -> str | None:
    """The language that a label names, null if it names none of the known ones."""
    if label is None:
        return None
    name = re.split(r"[-_]", label.strip().lower())[0].strip()
    for code, names in SPELLINGS.items():
        if name in names:
            return code
    return None


def paragraphs(text: str) -> list[str]:
    """The stretches of lines between blank lines; lines of white space only are blank."""
    out: list[list[str]] = [[]]
    for line in _LINE.split(text):
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(x) for x in out if x]


def tidy(text: str) -> str:
    """Composed letters without tags and invisible characters."""
    text = unicodedata.normalize("NFC", _TAG.sub(" ", text))
    if not text.isascii():
        odd = {ord(c): None for c in set(text) if ord(c) > 127 and unicodedata.category(c) == "Cf"}
        text = text.translate(odd) if odd else text
    return text


class HyperProfiles:
    """Language prototypes in a space of many random dimensions.

    A letter is a random vector of +1 and -1, drawn from a generator seeded by the letter. A
    run of n letters is the elementwise product of its letters' vectors, each rotated by its
    place, so every run has an almost orthogonal vector of its own. A word is the bundle, the
    sum, of its runs' vectors, a text the bundle of its words. A language is the bundle of all
    runs of its samples, each weighted by the root of its frequency; the mean of all languages
    is taken off, since what all share tells nothing, and prototypes are made of unit length. A
    text belongs to the prototype of greatest cosine.
    """

    def __init__(self, dims: int = 4096, sizes: tuple[int, ...] = (2, 3, 4), seed: int = 356) -> None:
        self.dims, self.sizes, self.seed = dims, sizes, seed
        self.letters: dict[str, np.ndarray] = {}
        self.codes: list[str] = []
        self.prototypes = np.zeros((0, dims), np.float32)
        self.sharpness = 1.0
        self.bound: dict[str, np.ndarray] = {}
        self.rows: dict[str, int] = {}
        self.words = np.zeros((0, dims), np.int16)

    def sibling(self) -> "HyperProfiles":
        """Profiles of the same space without prototypes; they share the vectors that were made."""
        other = HyperProfiles(self.dims, self.sizes, self.seed)
        other.letters, other.bound, other.rows = self.letters, self.bound, self.rows
        if not len(self.words):
            self.words = np.zeros((WORD_VECTORS, self.dims), np.int16)
        other.words = self.words
        return other

    def letter(self, c: str) -> np.ndarray:
        v = self.letters.get(c)
        if v is None:
            rng = np.random.default_rng([self.seed, zlib.crc32(c.encode("utf-8"))])
            v = self.letters[c] = rng.integers(0, 2, self.dims, dtype=np.int8) * 2 - 1
        return v

    def bind(self, run: str) -> np.ndarray:
        v = self.bound.get(run)
        if v is None:
            v = np.ones(self.dims, np.int8)
            for place, c in enumerate(run):
                v = v * np.roll(self.letter(c), place)
            if len(self.bound) >= 20_000:
                self.bound.clear()
            self.bound[run] = v
        return v

    def runs(self, word: str) -> list[str]:
        w = f" {word.lower()} "
        return [w[i : i + n] for n in self.sizes for i in range(len(w) - n + 1)]

    def bundle(self, texts: list[list[str]]) -> np.ndarray:
        """The vectors of lists of words."""
        out = np.zeros((len(texts), self.dims), np.float32)
        flat = [(i, w) for i, ws in enumerate(texts) for w in ws if len(w) <= KEPT_LETTERS]
        for i, ws in enumerate(texts):
            for w in ws:
                if len(w) > KEPT_LETTERS:
                    for r in self.runs(w):
                        out[i] += self.bind(r)
        for at in range(0, len(flat), AT_ONCE):
            part = flat[at : at + AT_ONCE]
            owner = np.fromiter((i for i, _ in part), np.int64, len(part))
            # 16 bits hold the sums of AT_ONCE words of KEPT_LETTERS letters.
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            places = self._places([w for _, w in part])
            vectors = self.words[places]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                out[owner[lo]] += np.add.reduce(vectors[lo:hi], axis=0, dtype=np.int16)
        return out

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the words' vectors stand among those that are kept."""
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(new) > WORD_VECTORS:
            self.rows.clear()
            new = list(dict.fromkeys(words))
        if not len(self.words):
            self.words = np.zeros((WORD_VECTORS, self.dims), np.int16)
        for w in new:
            v = np.zeros(self.dims, np.int16)
            for r in self.runs(w):
                v += self.bind(r)
            self.words[len(self.rows)] = v
            self.rows[w] = len(self.rows)
        return np.fromiter((self.rows[w] for w in words), np.int64, len(words))

    def cosines(self, bundles: np.ndarray) -> np.ndarray:
        """Cosine of each bundle with each prototype."""
        norms = np.linalg.norm(bundles, axis=1, keepdims=True)
        return bundles @ self.prototypes.T / np.maximum(norms, 1e-9)

    def evidence(self, cosines: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: cosines tell more the more words they stand on."""
        s = self.sharpness * cosines * np.sqrt(n_words)[:, None]
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def settle(self, codes: list[str], bundles: np.ndarray) -> "HyperProfiles":
        """Prototypes from each language's bundle of weighted runs."""
        p = bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        p = p - p.mean(axis=0) if len(codes) > 1 else p
        self.codes, self.prototypes = codes, (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return self

    def fit(self, samples: list[tuple[str, str]]) -> "HyperProfiles":
        """Prototypes from (language, text) samples; repeats and the order of samples play no part."""
        codes = sorted({lang for lang, _ in samples})
        counts: list[dict[str, int]] = [{} for _ in codes]
        for lang, text in sorted(set(samples)):
            own = counts[codes.index(lang)]
            for w in _WORD.findall(tidy(text)):
                for r in self.runs(w):
                    own[r] = own.get(r, 0) + 1
        bundles = np.zeros((len(codes), self.dims))
        for k, own in enumerate(counts):
            for r, n in own.items():
                bundles[k] += np.sqrt(n) * self.bind(r)
        return self.settle(codes, bundles)

    def calibrate(self, samples: list[tuple[str, str]]) -> "HyperProfiles":
        """The sharpness under which the probabilities fit samples that the prototypes don't know."""
        pieces = [(self.codes.index(lang), ws[i : i + n]) for lang, text in samples if lang in self.codes for ws in [_WORD.findall(tidy(text))] for n in (1, 2, 4, 8) for i in range(0, len(ws) - n + 1, n)]
        if not pieces:
            return self
        own, n = np.array([p[0] for p in pieces]), np.array([len(p[1]) for p in pieces])
        cosines = self.cosines(self.bundle([p[1] for p in pieces]))
        loss = {}
        for sharpness in np.geomspace(0.5, 200, 60):
            self.sharpness = float(sharpness)
            loss[self.sharpness] = -np.log(np.maximum(self.evidence(cosines, n)[np.arange(len(own)), own], 1e-12)).mean()
        self.sharpness = min(loss, key=loss.get)
        return self


def judge(model: HyperProfiles, texts: list[str]) -> list[list[tuple[int, str | None, int, float]]]:
    """(number, language, words, confidence) of every paragraph that has letters, for each text.

    Clauses are compared one by one, each with a little of its paragraph's vector, so a
    paragraph that mixes languages gets the one of most of its words. The language is null,
    with confidence 0, if the paragraph is nearer to chance than to any prototype.
    """
    clauses: list[list[str]] = []
    spans: list[tuple[int, int, int, int]] = []
    for i, text in enumerate(texts):
        for k, para in enumerate(paragraphs(text or "")):
            own = [ws for c in _CLAUSE.split(tidy(para)) if (ws := _WORD.findall(c))]
            if own:
                spans.append((i, k, len(clauses), len(clauses) + len(own)))
                clauses += own
    out: list[list[tuple[int, str | None, int, float]]] = [[] for _ in texts]
    if not clauses:
        return out
    bundles = model.bundle(clauses)
    sizes = np.array([len(c) for c in clauses])
    whole = np.stack([np.add.reduce(bundles[lo:hi], axis=0) for _, _, lo, hi in spans])
    total = np.add.reduceat(sizes, [s[2] for s in spans])
    cosines = model.cosines(whole)
    shares = model.evidence(cosines, total)
    nearest = np.repeat(np.arange(len(spans)), [s[3] - s[2] for s in spans])
    # A sum's cosines with the prototypes stand in the order of its products with them.
    products = whole @ model.prototypes.T
    votes = np.argmax(bundles @ model.prototypes.T + products[nearest] * (PARAGRAPH / total[nearest])[:, None], axis=1)
    strange = cosines.max(axis=1) < STRANGE
    for j, (i, k, lo, hi) in enumerate(spans):
        counts = np.bincount(votes[lo:hi], weights=sizes[lo:hi], minlength=len(model.codes))
        best = max(np.flatnonzero(counts == counts.max()), key=lambda c: cosines[j, c])
        sure = float(shares[j, best]) if best == np.argmax(shares[j]) else float(shares[j, best] + shares[j].max()) / 2
        out[i].append((k, None, int(total[j]), 0.0) if strange[j] else (k, model.codes[best], int(total[j]), sure))
    return out


def fit_profiles(samples: DataFrame, lang: str, text: str, dims: int = 4096, rows: int = SAMPLE_ROWS) -> HyperProfiles:
    """Prototypes from a bounded sample of labelled rows, at most `rows`, those of least hash if there are more.

    Runs are counted and bundled in tasks; the driver adds their few vectors and gets the bounded
    sample once more to calibrate the confidence, on each third of it by prototypes of the other two. The
    bound concerns only the fit; every document is judged, and whole.
    """
    names = F.create_map(*[F.lit(x) for code, own in SPELLINGS.items() for name in own for x in (name, code)])
    code = F.element_at(names, F.trim(F.split(F.lower(F.trim(F.col(lang))), "[-_]")[0]))
    some = samples.select(code.alias("code"), F.col(text).alias("t")).where("code is not null and t is not null and t <> ''").distinct().orderBy(F.xxhash64("t"), "t", "code").limit(rows)
    pairs = [(r["code"], r["t"]) for r in cut(some).collect()]
    model = HyperProfiles(dims)
    if not pairs:
        return model
    spark, settings = samples.sparkSession, (model.dims, model.sizes, model.seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = HyperProfiles(*settings)
        for batch in batches:
            own: dict[tuple[str, str], int] = {}
            for code, t in zip(*(c.to_pylist() for c in batch.columns)):
                for w in _WORD.findall(tidy(t)):
                    for r in local.runs(w):
                        own[code, r] = own.get((code, r), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()), pa.array(own.values(), pa.int64())], names=["code", "run", "n"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, sums = HyperProfiles(*settings), {}
        for batch in batches:
            for code, r, n in zip(*(c.to_pylist() for c in batch.columns)):
                if code not in sums:
                    sums[code] = np.zeros(local.dims)
                sums[code] += np.sqrt(n) * local.bind(r)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["code", "v"])

    rows_ = spark.createDataFrame(pairs, "code string, t string").repartition(4)
    counts = rows_.mapInArrow(count, "code string, run string, n bigint").groupBy("code", "run").agg(F.sum("n").alias("n"))
    sums: dict[str, np.ndarray] = {}
    for r in sorted(counts.mapInArrow(bundle, "code string, v array<double>").collect(), key=lambda r: (r["code"], r["v"][:8])):
        sums[r["code"]] = sums.get(r["code"], 0.0) + np.array(r["v"])
    codes = sorted(sums)
    model.settle(codes, np.array([sums[c] for c in codes]))
    if len(pairs) >= 30:
        thirds = [model.sibling().fit([p for i, p in enumerate(pairs) if i % 3 != k]).calibrate([p for i, p in enumerate(pairs) if i % 3 == k]).sharpness for k in range(3)]
        model.sharpness = float(np.exp(np.mean(np.log(thirds))))
    return model


def document_languages(docs: DataFrame, doc_id: str, text: str, lang: str, model: HyperProfiles) -> DataFrame:
    """(doc_id, seg_no, lang_code, confidence, n_words, labelled, mixed) of documents and paragraphs.

    seg_no -1 is the document with the language of most of its words; 0, 1, ... are its
    paragraphs. labelled is the language that the label names, null for none; mixed tells
    whether the paragraphs are in more than one language. Texts that are null, empty or without
    letters give no rows; a paragraph without letters keeps its number but gives no row. One that
    is near no prototype has a null language and confidence 0 and counts for the document only
    if all its paragraphs are so. A tie between languages goes to the one with the stronger
    evidence. Repeated rows are judged each. A pure map; only the prototypes, of fixed size, are
    sent to the executors.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.dims, model.sizes, model.seed, model.codes, model.prototypes, model.sharpness))
    fields = [("doc", pa.int64()), ("seg_no", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64()), ("n_words", pa.int32()), ("labelled", pa.string()), ("mixed", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, sizes, seed, codes, prototypes, sharpness = shipped.value
        local = HyperProfiles(dims, sizes, seed)
        local.codes, local.prototypes, local.sharpness = codes, prototypes, sharpness
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(at, DOCUMENTS_AT_ONCE)
                cols: list[list] = [[] for _ in fields]
                idents, texts, labels = (batch.column(i).to_pylist() for i in range(3))
                for ident, label, segments in zip(idents, labels, judge(local, texts)):
                    if not segments:
                        continue
                    by: dict[str | None, list[float]] = {}
                    for _, code, n, sure in segments:
                        own = by.setdefault(code, [0, 0.0])
                        own[0] += n
                        own[1] += n * sure
                    named_ = [c for c in by if c is not None]
                    best = max(named_, key=lambda c: (by[c][0], by[c][1], c)) if named_ else None
                    total, mixed, named = sum(v[0] for v in by.values()), len(named_) > 1, spelled(label)
                    for row in [(ident, -1, best, by[best][1] / total, total, named, mixed), *((ident, k, code, sure, n, named, mixed) for k, code, n, sure in segments)]:
                        for c, v in zip(cols, row):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    if not model.codes:
        return spark.createDataFrame([], f"{doc_id} bigint, seg_no int, lang_code string, confidence double, n_words int, labelled string, mixed boolean")
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.col(lang).cast("string")).where(F.col(text).isNotNull())
    out = rows.mapInArrow(run, "doc bigint, seg_no int, lang_code string, confidence double, n_words int, labelled string, mixed boolean")
    return out.withColumnRenamed("doc", doc_id)
