"""Operator 10, language identification: a linear-chain conditional random field
over words, decoded by forward-backward.

A word's features are its first and last three bytes (affixes), its byte trigrams
with the spaces around it, and itself (lexicon), all hashed; transitions between
the languages of neighbouring words are learned, so code-switched text is labelled
word by word. A document's language is the one with the most marginal probability
over its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, map_batches, mix, span_hashes, string_buffers, table, word_spans

TRIGRAMS, AFFIXES, LEXICON = 1 << 15, 1 << 15, 1 << 17
#: Documents of each language that the field is trained on at most.
FIT_DOCS = 120
SEGMENT = 32
_LETTER = re.compile(r"[^\W\d_]")
_TO_LETTER = np.zeros(256, bool)
_TO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """Words of some texts: the text each is from, its feature numbers, and whether
    it has a letter."""

    text: np.ndarray
    grams: np.ndarray  # at every byte
    start: np.ndarray
    end: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    letters: np.ndarray


def read_words(whole: bytes, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    at = offsets.tolist()
    data = np.frombuffer(b" " + b" ".join([whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]) + b"  ", np.uint8)
    data = _LOWER[data]
    data = np.where((data < 33) & (data > 8), np.uint8(32), data)
    begins = offsets[:-1] + 1 + np.arange(n)
    start, end, _ = word_spans(data, np.array([0, len(data)]))
    text = np.searchsorted(begins, start, side="right") - 1
    wide = data.astype(np.int32)
    grams = np.zeros(len(data), np.int32)
    grams[:-2] = (wide[:-2] * 961 + wide[1:-1] * 31 * 17 + wide[2:] * 7) * 40503 >> 3 & TRIGRAMS - 1
    lexicon = (span_hashes(data, start, end) >> np.uint64(40)).astype(np.int64) & LEXICON - 1
    prefix = (mix(span_hashes(data, start, np.minimum(start + 3, end)) + np.uint64(1)) >> np.uint64(40)).astype(np.int64) & AFFIXES - 1
    suffix = (mix(span_hashes(data, np.maximum(end - 3, start), end) + np.uint64(2)) >> np.uint64(40)).astype(np.int64) & AFFIXES - 1
    known = np.concatenate([[0], np.cumsum(_TO_LETTER[data])])
    return Words(text, grams, start, end, prefix, suffix, lexicon, known[end] > known[start])


@dataclass
class Field:
    languages: list[str]
    grams: np.ndarray  # feature x language
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray  # language x language

    def scores(self, w: Words) -> np.ndarray:
        out = self.prefix[w.prefix] + self.suffix[w.suffix] + self.lexicon[w.lexicon]
        for k in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(self.grams[:, k][w.grams], dtype=np.float64)])
            out[:, k] += sums[w.end - 1] - sums[w.start - 1]  # trigrams from the space before to the space after
        return out


def marginals(scores: np.ndarray, text: np.ndarray, n: int, moves: np.ndarray) -> np.ndarray:
    """P(language) of every word, given the words of its text, exactly.

    Texts are cut into segments of SEGMENT words. Their transfer matrices are built
    side by side, chained over each text from both ends, and then every segment is
    run forward and backward from its known boundary, again side by side.
    """
    words, k = scores.shape
    if not words:
        return scores
    count = np.bincount(text, minlength=n)
    segments = -(-count // SEGMENT)
    first_word = np.concatenate([[0], np.cumsum(count)[:-1]])
    first_segment = np.concatenate([[0], np.cumsum(segments)])
    total = int(first_segment[-1])
    owner = np.repeat(np.arange(n), segments)
    begin = first_word[owner] + (np.arange(total) - first_segment[owner]) * SEGMENT
    size = np.minimum(SEGMENT, first_word[owner] + count[owner] - begin)
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    a = np.exp(moves - moves.max())
    live = [np.flatnonzero(size > t) for t in range(SEGMENT)]
    m = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t, rows in enumerate(live):
        x = (m[rows].reshape(-1, k) @ a).reshape(-1, k, k) * psi[begin[rows] + t][:, None, :]
        m[rows] = x / x.sum(axis=(1, 2), keepdims=True)
    forward, backward = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
    by_length = np.argsort(-segments, kind="stable")
    lengths = segments[by_length]
    for s in range(1, int(lengths[0]) if n else 0):
        texts = by_length[: np.searchsorted(-lengths, -s, side="left")]
        here = first_segment[texts] + s
        x = np.einsum("ni,nij->nj", forward[here - 1], m[here - 1])
        forward[here] = x / x.sum(axis=1, keepdims=True)
        here = first_segment[texts + 1] - 1 - s
        x = np.einsum("nij,nj->ni", m[here + 1], backward[here + 1])
        backward[here] = x / x.sum(axis=1, keepdims=True)
    out = np.empty((words, k))
    alpha = forward
    for t, rows in enumerate(live):
        x = (alpha[rows] @ a) * psi[begin[rows] + t]
        alpha[rows] = x / x.sum(axis=1, keepdims=True)
        out[begin[rows] + t] = alpha[rows]
    beta = backward
    for t in range(SEGMENT - 1, -1, -1):
        rows = live[t]
        at = begin[rows] + t
        out[at] *= beta[rows]
        x = (psi[at] * beta[rows]) @ a.T
        beta[rows] = x / x.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]], steps: int = 160, batch: int = 96, length: int = 24, seed: int = 7) -> Field:
    """Conditional log-likelihood by AdaGrad on sequences of ``length`` words, whole
    or code-switched: pieces of texts in different languages, one after another."""
    samples = sorted(samples)
    languages = sorted({lang for lang, _ in samples})
    k = len(languages)
    field = Field(languages, np.zeros((TRIGRAMS, k)), np.zeros((AFFIXES, k)), np.zeros((AFFIXES, k)), np.zeros((LEXICON, k)), np.zeros((k, k)))
    if k < 2:
        return field
    raw = [t.encode("utf-8", "surrogatepass") for _, t in samples]
    w = read_words(b"".join(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    count = np.bincount(w.text, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    by_language = [[i for i, (lang, _) in enumerate(samples) if lang == x and count[i] > 0] for x in languages]
    usable = [i for i, x in enumerate(by_language) if x]
    rng = np.random.default_rng(seed)
    tables = {"grams": field.grams, "prefix": field.prefix, "suffix": field.suffix, "lexicon": field.lexicon, "moves": field.moves}
    seen = {x: np.full(v.shape, 1e-2) for x, v in tables.items()}
    for _ in range(steps if usable else 0):
        picked, labels = [], []
        for _ in range(batch):
            seq, marks = [], []
            cuts = [length] if rng.random() < 0.5 else np.diff([0, *sorted(rng.choice(np.arange(2, length - 1), rng.integers(1, 3), replace=False)), length])
            for size in cuts:
                lang = usable[rng.integers(len(usable))]
                doc = by_language[lang][rng.integers(len(by_language[lang]))]
                at = first[doc] + (rng.integers(max(1, count[doc] - size + 1)) + np.arange(size)) % count[doc]
                seq += at.tolist()
                marks += [lang] * int(size)
            picked += seq
            labels += marks
        at, y = np.array(picked), np.array(labels)
        spans = w.end[at] - w.start[at]
        gram_at = np.repeat(w.start[at] - 1, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        gram_owner = np.repeat(np.arange(len(at)), spans)
        gram = w.grams[gram_at]
        scores = field.prefix[w.prefix[at]] + field.suffix[w.suffix[at]] + field.lexicon[w.lexicon[at]]
        for c in range(k):
            scores[:, c] += np.bincount(gram_owner, weights=field.grams[gram, c], minlength=len(at))
        psi = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(batch, length, k) + 1e-12
        a = np.exp(field.moves - field.moves.max())
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        x = np.full((batch, k), 1.0 / k)
        for t in range(length):
            x = (x @ a) * psi[:, t]
            x /= x.sum(axis=1, keepdims=True)
            alpha[:, t] = x
        for t in range(length - 2, -1, -1):
            x = (psi[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] = x / x.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        before = alpha[:, :-1]
        after = psi[:, 1:] * beta[:, 1:]
        pairs = before[:, :, :, None] * a * after[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        truth = y.reshape(batch, length)
        gain = np.zeros((k, k))
        np.add.at(gain, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        gains = -p.reshape(-1, k)
        gains[np.arange(len(at)), y] += 1

        def climb(name: str, rows: np.ndarray, g: np.ndarray) -> None:
            used, place = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(place, weights=g[:, c], minlength=len(used)) for c in range(k)], axis=1) / batch
            seen[name][used] += total**2
            tables[name][used] += 0.15 * total / np.sqrt(seen[name][used])

        climb("grams", gram, gains[gram_owner])
        climb("prefix", w.prefix[at], gains)
        climb("suffix", w.suffix[at], gains)
        climb("lexicon", w.lexicon[at], gains)
        g = (gain - pairs.sum(axis=(0, 1))) / batch
        seen["moves"] += g**2
        field.moves += 0.15 * g / np.sqrt(seen["moves"])
    return field


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """Trained on at most ``fit_docs`` documents of each language whose
    crc32(doc_id) mod 3 isn't 1 (those of smallest hash), whole texts."""
    known = docs.where((fold("doc_id") != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= fit_docs).select("doc_id", "lang").distinct()
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").collect()
    return train([(r.lang, r.text) for r in rows])


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, switches) for every row of ``docs``.

    The whole text is labelled; ``lang_pred`` has the largest mean marginal over
    the words with a letter, ``score`` is that mean, ``switches`` counts changes of
    the most probable language between such words. A null text or one without a
    letter is ``und`` with score 0, as is everything if nothing could be learned.
    Only the text is read for a prediction. A null doc_id isn't held out; repeated
    rows, extra columns and empty tables change nothing. Rows are labelled where
    they are read; only the weights travel.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        f = shared.value
        data, offsets = string_buffers(batch.column(1))
        n, k = batch.num_rows, len(f.languages)
        lettered = np.array([bool(x and _LETTER.search(x)) for x in batch.column(1).to_pylist()], bool)
        names, score, switches = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
        if k:
            w = read_words(data.tobytes(), offsets)
            p = marginals(f.scores(w), w.text, n, f.moves)
            text, p = w.text[w.letters], p[w.letters]
            count = np.bincount(text, minlength=n)
            mean = np.stack([np.bincount(text, weights=p[:, c], minlength=n) for c in range(k)], axis=1) / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1)
            top = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            changed = (top[1:] != top[:-1]) & (text[1:] == text[:-1])
            switches = np.bincount(text[1:][changed], minlength=n)
            good = lettered & (count > 0)
            names = [f.languages[b] if g else "und" for b, g in zip(best, good, strict=True)]
            score = np.where(good, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": names, "score": score, "switches": switches}

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"))
    return map_batches(slim, kernel, f"doc_id {kind}, held_out boolean, lang_pred string, score double, switches long", 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
