"""Languages of documents and of the segments of mixed ones.

One interpolated Kneser-Ney character model per language, over words with their
borders, held in sorted arrays of n-gram hashes. The models are fitted on a
bounded sample of labelled documents (``sample_docs`` a language, chosen by hash
of the identifier); as labels may be wrong, blocks that a first fit assigns to
another language are left out of a second fit. A block gets the language of the
lowest cross-entropy per character; where the lead over the next language is
small, each sentence is scored and the language of most letters wins. A block whose cross-entropy is above what
held-out blocks of that language show is rejected: it has no language.

Everything else covers all documents and whole texts. A worker remembers the
scores of words it has met; that cache is bounded and doesn't change results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 639 codes and English names. Fixed values.
LABELS = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "ja": ("ja", "jpn", "japanese"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pl": ("pl", "pol", "polish"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
    "sv": ("sv", "swe", "swedish"),
    "tr": ("tr", "tur", "turkish"),
}
LANGUAGES = tuple(LABELS)
MIN_LETTERS = 40
NOT_PROSE = "={|#*:;!<[_"
ORDER = 5
# characters whose evidence the confidence counts: neighbouring n-grams aren't independent
EVIDENCE = 16
# below this lead in bits a character, a block's language is decided by its sentences' letters
UNSURE_GAP = 1.5
_PAD, _END = 1, 2
_CACHE_ENTRIES = 1 << 17

_BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")
_SENTENCES = re.compile(r"(?<=[.!?»])\s+|(?<=[。！？])|(?=«)")
# letters; runs of kanji and of each kana script count as words of their own
_WORDS = re.compile(r"[㐀-鿿々]+|[぀-ゟ]+|[゠-ヿ]+|[^\W\d_㐀-鿿々぀-ヿ]+")


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, in any case and with or without a region; null if it names none."""
    base = F.split(F.lower(F.trim(label)), "[-_]")[0]
    out = F.lit(None).cast("string")
    for code, names in LABELS.items():
        out = F.when(F.trim(base).isin(*names), F.lit(code)).otherwise(out)
    return out


def blocks_of(text: str) -> list[str]:
    """The blocks of a text: what lies between lines that are empty or white space."""
    return [b for b in _BLANK_LINES.split(text) if b and not b.isspace()]


def is_prose_start(block: str) -> bool:
    return block.lstrip()[:1] not in NOT_PROSE


def words_of(chunk: str) -> list[str]:
    return _WORDS.findall(chunk)


# --------------------------------------------------------------------------- models
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each predicted character, of orders 0 to ORDER, their contexts' too.

    Gives (hashes by order, start of each word's positions); order n's context
    is order n-1's hash one place before.
    """
    pad = chr(_PAD) * (ORDER - 1)
    text = "".join([pad + w + chr(_END) for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + ORDER for w in words])
    ends = np.cumsum(size)
    predicted = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        predicted[ends - size + k] = False
    at = np.flatnonzero(predicted)
    hashes = [np.zeros(len(codes), np.uint64)]
    for n in range(1, ORDER + 1):
        back = np.zeros(len(codes), np.uint64)
        back[n - 1 :] = codes[: len(codes) - n + 1]
        hashes.append(_mix(hashes[-1] * np.uint64(31) + back + np.uint64(n)))
    return hashes, at, np.r_[0, np.cumsum(size - ORDER + 1)[:-1]]


@dataclass
class Model:
    """Sorted n-gram hashes with their discounted probabilities, sorted context hashes with their back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: float

    def log2(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), self.base)
        for n in range(1, ORDER + 1):
            keys, value = self.grams[n - 1]
            contexts, weight = self.contexts[n - 1]
            w, known = _lookup(contexts, weight, hashes[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64))
            v, _ = _lookup(keys, value, hashes[n][at])
            p = np.where(known, v + w * p, p)
        return np.log2(p)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[i] == wanted
    return np.where(hit, values[i], 0.0), hit


def fit_model(counts: dict[str, int], alphabet: int) -> Model:
    """A model of words with their counts: full counts in the highest order, continuation counts below."""
    words = list(counts)
    grams: list = [None] * ORDER
    contexts: list = [None] * ORDER
    if not words:
        none = (np.empty(0, np.uint64), np.empty(0))
        return Model([none] * ORDER, [none] * ORDER, 1 / alphabet)
    hashes, at, _ = _grams(words)
    weight = np.repeat(np.array(list(counts.values()), float), [len(w) + 1 for w in words])
    where = at
    for n in range(ORDER, 0, -1):
        keys, first, inverse = np.unique(hashes[n][where], return_index=True, return_inverse=True)
        c = np.bincount(inverse, weight)
        rep = where[first]
        context = hashes[n - 1][rep - 1] if n > 1 else np.zeros(len(rep), np.uint64)
        ctx, ci = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(ci, c), np.bincount(ci)
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        grams[n - 1] = (keys, (np.maximum(c - d, 0) / total[ci]))
        contexts[n - 1] = (ctx, d * kinds / total)
        # below, a gram counts as often as it continues different longer ones
        where, weight = rep, np.ones(len(rep))
    return Model(grams, contexts, 1 / alphabet)


class Scorer:
    """Bits by language of chunks of text, with a cache of chunks and words."""

    def __init__(self, models: list[Model]):
        self.models = models
        self._reset()

    def _reset(self) -> None:
        self._row: dict[str, int] = {}
        self._bits = np.zeros((1024, len(self.models)), np.float32)
        self._letters = np.zeros(1024, np.int32)
        self._chars = np.zeros(1024, np.int32)
        self._word_bits: dict[str, np.ndarray] = {}

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Negative log2 probabilities (word, language)."""
        hashes, at, start = _grams(words)
        return np.stack([-np.add.reduceat(m.log2(hashes, at), start) for m in self.models], axis=1).astype(np.float32)

    def _learn(self, chunks: list[str]) -> None:
        parts = [[w.lower() for w in words_of(c)] for c in chunks]
        new = list({w for ws in parts for w in ws} - self._word_bits.keys())
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            self._word_bits.update(zip(some, self.word_bits(some)))
        need = len(self._row)
        if need > len(self._bits):
            grow = 2 * need
            for name in ("_bits", "_letters", "_chars"):
                old = getattr(self, name)
                fresh = np.zeros((grow, *old.shape[1:]), old.dtype)
                fresh[: len(old)] = old
                setattr(self, name, fresh)
        for c, ws in zip(chunks, parts):
            i = self._row[c]
            self._letters[i] = sum(map(str.isalpha, c))
            self._chars[i] = sum(map(len, ws)) + len(ws)
            if ws:
                self._bits[i] = np.sum([self._word_bits[w] for w in ws], axis=0)

    def score(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits by language, letters, predicted characters) of each part."""
        if len(self._row) > _CACHE_ENTRIES:
            self._reset()
        row, new = self._row, []
        rows: list[int] = []
        sizes = []
        for p in parts:
            chunks = p.split()
            for c in chunks:
                i = row.get(c)
                if i is None:
                    i = row[c] = len(row)
                    new.append(c)
                rows.append(i)
            sizes.append(len(chunks))
        if new:
            self._learn(new)
        at = np.array(rows, np.int64)
        size = np.array(sizes, np.int64)
        n = len(parts)
        bits, letters, chars = np.zeros((n, len(self.models))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        full = np.flatnonzero(size)
        if full.size:
            start = np.r_[0, np.cumsum(size[full])[:-1]]
            bits[full] = np.add.reduceat(self._bits[at], start, axis=0)
            letters[full] = np.add.reduceat(self._letters[at], start)
            chars[full] = np.add.reduceat(self._chars[at], start)
        return bits, letters, chars


# --------------------------------------------------------------------------- fitting
@dataclass
class Identifier:
    """Models, and the limits of bits a character that were calibrated on held-out blocks."""

    models: list[Model]
    limits: np.ndarray


def _texts_to_blocks(texts: list[str]) -> list[str]:
    return [b for t in texts for b in blocks_of(unicodedata.normalize("NFC", t)) if is_prose_start(b)]


def _count_words(blocks: list[str]) -> Counter:
    out: Counter = Counter()
    for b in blocks:
        out.update(w.lower() for w in words_of(b))
    return out


def fit_identifier(sample: dict[str, list[str]], alphabet: int = 3000) -> Identifier | None:
    """Fit on labelled texts, of which every fifth is held out; None without any word."""
    train = {c: _texts_to_blocks([t for i, t in enumerate(sample.get(c, [])) if i % 5]) for c in LANGUAGES}
    held = {c: _texts_to_blocks([t for i, t in enumerate(sample.get(c, [])) if i % 5 == 0]) for c in LANGUAGES}
    counts = {c: _count_words(b) for c, b in train.items()}
    if not any(counts.values()):
        return None
    scorer = Scorer([fit_model(counts[c], alphabet) for c in LANGUAGES])
    for k, c in enumerate(LANGUAGES):
        bits, _, chars = scorer.score(train[c])
        own = [b for b, v, n in zip(train[c], bits, chars) if n and v.argmin() == k]
        counts[c] = _count_words(own) or counts[c]
    models = [fit_model(counts[c], alphabet) for c in LANGUAGES]
    scorer = Scorer(models)
    limits = np.full(len(LANGUAGES), np.inf)
    for k, c in enumerate(LANGUAGES):
        bits, letters, chars = scorer.score(held[c])
        good = (letters >= MIN_LETTERS) & (bits.argmin(axis=1) == k) if len(bits) else np.empty(0, bool)
        if good.sum() >= 10:
            limits[k] = 1.5 * np.quantile(bits[good, k] / chars[good], 0.995)
    return Identifier(models, limits)


def labelled_sample(df: DataFrame, sample_docs: int, max_chars: int, id_column: str, text_column: str, label_column: str) -> dict[str, list[str]]:
    """At most ``sample_docs`` texts of each language, of at most ``max_chars`` characters, chosen by hash of the identifier."""
    named = df.select(F.xxhash64(id_column).alias("h"), F.col(text_column).alias("t"), label_language(F.col(label_column)).alias("c"))
    found = {r[0]: r[1] for r in named.where("c is not null").groupBy("c").count().collect()}
    scale = 1 << 20
    wanted = F.lit(0)
    for c, n in found.items():
        wanted = F.when(F.col("c") == c, F.lit(min(scale, 2 * sample_docs * scale // n + 1))).otherwise(wanted)
    rows = named.where(F.col("c").isNotNull() & (F.pmod("h", F.lit(scale)) < wanted) & (F.length("t") <= max_chars) & (F.length("t") > 0)).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.h % scale, r.h)):
        if len(have := out.setdefault(r.c, [])) < sample_docs:
            have.append(r.t)
    return out


# --------------------------------------------------------------------------- all documents
_OUT = "seg_no int, lang string, confidence double, bits_per_char double, letters long, named string"


def identify(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample_docs: int = 150, max_sample_chars: int = 20_000
) -> DataFrame:
    """(<id>, seg_no, lang, confidence, bits_per_char, letters, named) for every document and every segment of mixed ones.

    seg_no 0 is the document; a document whose prose blocks are in more than one
    language also has each of its prose blocks, under the block's number. A
    document's language is that of most letters of its prose blocks, its
    confidence theirs by letters, letters in other languages counting as 0.
    Documents without prose block (null and
    empty texts too) and rejected blocks have a null language and confidence 0.
    ``named`` is the language that the delivered label names, or null. Of languages
    with equally many letters the first by code wins. Rows are independent, so
    null and repeated ids stay as they are; other columns are not read. An empty
    table gives no rows, and without any labelled text no row has a language.
    """
    spark = df.sparkSession
    fitted = fit_identifier(labelled_sample(df, sample_docs, max_sample_chars, id_column, text_column, label_column))
    shared = spark.sparkContext.broadcast(fitted)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.models) if shared.value else None
        for b in batches:
            for a in range(0, b.num_rows, 500):
                yield from _identify_some(b.slice(a, 500), scorer, shared.value, id_column)

    return df.select(id_column, text_column, label_language(F.col(label_column)).alias("named")).mapInArrow(run, f"`{id_column}` {kind}, {_OUT}")


def _identify_some(b: pa.RecordBatch, scorer: Scorer | None, fitted: Identifier | None, id_column: str) -> Iterator[pa.RecordBatch]:
    texts, named = b.column(1).to_pylist(), b.column(2).to_pylist()
    doc, place, parts = [], [], []
    for i, t in enumerate(texts):
        if not t or fitted is None:
            continue
        if not unicodedata.is_normalized("NFC", t):
            t = unicodedata.normalize("NFC", t)
        for k, block in enumerate(blocks_of(t), 1):
            if len(block) >= MIN_LETTERS and is_prose_start(block):
                doc.append(i)
                place.append(k)
                parts.append(block)
    own: list[list[tuple]] = [[] for _ in texts]
    if parts:
        bits, letters, chars = scorer.score(parts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(parts)), best]
        rate = low / np.maximum(chars, 1)
        gap = (bits - low[:, None]) * (np.minimum(chars, EVIDENCE) / np.maximum(chars, 1))[:, None]
        sure = 1 / np.exp2(-gap).sum(axis=1)
        lead = np.partition(bits, 1, axis=1)[:, 1] - low
        for j in np.flatnonzero(lead < UNSURE_GAP * chars).tolist():
            k, part = _by_sentences(scorer, parts[j])
            if k is not None:
                best[j], sure[j] = k, part
        for i, k, n, j, r, p in zip(doc, place, letters.tolist(), best.tolist(), rate.tolist(), sure.tolist()):
            if n >= MIN_LETTERS:
                taken = r <= fitted.limits[j]
                own[i].append((k, LANGUAGES[j] if taken else None, p if taken else 0.0, r, n))
    rows = []
    for i, blocks in enumerate(own):
        by: dict[str, int] = {}
        for _, lang, _, _, n in blocks:
            if lang:
                by[lang] = by.get(lang, 0) + n
        top = max(sorted(by), key=by.__getitem__) if by else None
        same = [x for x in blocks if x[1] == top] if top else []
        total = sum(x[4] for x in blocks)
        sure_of = sum(x[2] * x[4] for x in same) / total if same else 0.0
        rate_of = sum(x[3] * x[4] for x in same) / sum(x[4] for x in same) if same else None
        rows.append((i, 0, top, sure_of, rate_of, total))
        if len(by) > 1:
            rows += [(i, *x) for x in blocks]
    cols = list(zip(*rows)) or [()] * 6
    at = pa.array(cols[0], pa.int64())
    kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [b.column(0).take(at), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)], pa.array(named, pa.string()).take(at)],
        [id_column, "seg_no", "lang", "confidence", "bits_per_char", "letters", "named"],
    )


def _by_sentences(scorer: Scorer, block: str) -> tuple[int | None, float]:
    """The language of most letters of a block's sentences, and its part of them."""
    bits, letters, _ = scorer.score([x for x in _SENTENCES.split(block) if x])
    if not letters.sum():
        return None, 0.0
    by = np.bincount(bits.argmin(axis=1), letters, minlength=len(LANGUAGES))
    return int(by.argmax()), float(by.max() / by.sum())


def label_faults(found: DataFrame) -> DataFrame:
    """Rows of ``identify`` where the label is missing or names another language, and all segments."""
    return found.where("lang is not null and (seg_no > 0 or named is null or named <> lang)")
