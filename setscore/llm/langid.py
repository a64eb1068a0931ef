"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, character n-grams and the lexicons of the learned languages that
hold it, hashed into one weight table; learned transitions join neighbouring words of a line.
Forward-backward gives every word a distribution over the languages, so code-switched text is
labelled word by word; a document's language has the largest mean probability.

The field is fitted on the driver on a bounded sample: ``SAMPLE_DOCS`` different documents of a language,
the first ``SAMPLE_CHARS`` characters of each, from labelled documents whose crc32(doc_id) mod 3 isn't 1;
a null doc_id has no such remainder and isn't learned from. Each language has its own places in the
sample, repeated rows take one, and reruns choose the same. Pieces of
different languages are strung together, so that switches are seen. Only text and lang are learned from;
predictions use text alone, over whole texts.

Documents are read once and never shuffled. Words are found and hashed per batch; each different
word's weights are summed once per batch, and all lines of a batch go through the chain together.

A text that is null or has no letter is ``und`` with score 0, and so is all if nothing is labelled. Repeated
rows each give their own row. Other columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.llm.common import WordHasher, append_column, bytes_of, free_name, table

SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
PARTS = 16                   # of a language's keys, ranked apart before they are ranked together
SEQUENCES = 4_000            # of training words strung together
SEQUENCE_WORDS = 24
EPOCHS = 3
LEXICON_COUNT = 3            # a word so frequent in a language's sample is in its lexicon
BUCKETS = 1 << 16
BATCH_BYTES = 1 << 21        # text that goes through the chain together
SEED = 5
UNKNOWN = "und"

SEGMENT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
                       T.StructField("segments", T.ArrayType(SEGMENT))])


def word_bytes() -> np.ndarray:
    """Bytes of words: ASCII letters and everything beyond ASCII."""
    ok = np.zeros(256, dtype=bool)
    ok[0x41:0x5B] = ok[0x61:0x7B] = ok[0x80:] = True
    return ok


def features(data: bytes, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray):
    """(buckets, first position): for each feature kind an array of buckets over the positions of all
    words, BUCKETS where a position has none; the words' positions follow each other.

    Kinds are byte n-grams of the word with its edges marked, which cover affixes of up to three
    letters; affixes of four; the word itself; and the set of lexicons that hold it.
    """
    size = end - start
    total = size + 2
    first = np.cumsum(total) - total
    n = int(total.sum())
    text = np.zeros(n + 5, dtype=np.uint64)
    inner = np.ones(n, dtype=bool)
    inner[first] = inner[first + total - 1] = False
    raw = np.frombuffer(data, dtype=np.uint8)
    byte = raw[np.arange(n - 2 * len(size)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
    text[:n][inner] = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    text[first], text[first + total - 1] = 94, 36
    left = np.repeat(first + total, total) - np.arange(n)        # characters from here to the word's end

    def bucket(code: np.ndarray, kind: int) -> np.ndarray:
        mixed = (code + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS

    kinds, code = [], np.zeros(n, dtype=np.uint64)
    for k in range(1, 6):
        code = code | text[k - 1:n + k - 1] << np.uint64(8 * k - 8)
        ok = left >= k
        if k == 5:
            edge = np.zeros(n, dtype=bool)
            edge[first] = True
            ok &= edge | (left == k)
        kinds.append(np.where(ok, bucket(code, k), BUCKETS))
    for k, value in ((6, WordHasher(word_bytes()).spans(data, start, end)), (7, lexicon.astype(np.uint64))):
        once = np.full(n, BUCKETS)
        once[first] = bucket(value & np.uint64((1 << 56) - 1), k)
        kinds.append(once)
    return kinds, first


class Chain:
    """Weights of a fitted field."""

    def __init__(self, languages: list[str], lexicons: dict[int, int]):
        self.languages = languages
        # hash of a word: a bit for each language whose lexicon holds it
        self.words = np.array(sorted(lexicons), dtype=np.uint64)
        self.bits = np.array([lexicons[w] for w in sorted(lexicons)], dtype=np.uint64)
        self.weights = np.zeros((BUCKETS + 1, len(languages)), dtype=np.float32)     # the last stays 0
        self.steps = np.zeros((len(languages), len(languages)), dtype=np.float32)

    def lexicon(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.bits[at], np.uint64(0))

    def emissions(self, data: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Summed weights of the features of each word."""
        kinds, first = features(data, start, end, self.lexicon(h))
        return sum(np.add.reduceat(self.weights[k], first, axis=0) for k in kinds)


def has_letter(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether words have a letter; only those that begin beyond ASCII need a look."""
    out = np.ones(len(start), dtype=bool)
    first = np.frombuffer(data, dtype=np.uint8)[start] if len(start) else np.zeros(0, np.uint8)
    for k in np.flatnonzero(first >= 0x80):
        out[k] = any(c.isalpha() for c in data[start[k]:end[k]].decode())
    return out


def forward_backward(emission: np.ndarray, steps: np.ndarray, begin: np.ndarray, length: np.ndarray, count: bool = False):
    """Word probabilities of chains that begin at ``begin`` and have ``length`` words in ``emission``,
    and (if asked for) the expected count of each step; all chains go in step with each other."""
    n, k = emission.shape
    counts = np.zeros((k, k))
    if not n:
        return emission, counts
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(steps)
    ahead = local / local.sum(axis=1, keepdims=True)
    back = np.ones_like(local)
    by = np.argsort(-length, kind="stable")
    begin, length = begin[by], length[by]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    for t in range(1, len(live)):                   # live[t] chains have more than t words
        at = begin[:live[t]] + t
        a = (ahead[at - 1] @ move) * local[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(live) - 1, 0, -1):
        at = begin[:live[t]] + t
        tail = local[at] * back[at]
        if count:
            pair = ahead[at - 1][:, :, None] * move[None] * tail[:, None, :]
            counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = tail @ move.T
        back[at - 1] = b / b.sum(axis=1, keepdims=True)
    prob = ahead * back
    return prob / prob.sum(axis=1, keepdims=True), counts


def fit(texts: list[tuple[str, str]]) -> Chain:
    """A field fitted to (text, language) samples."""
    languages = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(SEED)
    hasher = WordHasher(word_bytes())
    data = "\n".join(t for t, _ in texts).encode() + b"\n"
    h, s, e = hasher.words(data)
    document = np.searchsorted(np.cumsum([len(t.encode()) + 1 for t, _ in texts]), s, side="right")
    letter = has_letter(data, s, e)
    h, s, e, document = h[letter], s[letter], e[letter], document[letter]
    label = np.array([languages.index(lang) for _, lang in texts], dtype=np.int64)[document] if len(h) else document
    lexicons: Counter = Counter()
    for k in range(len(languages)):
        words, c = np.unique(h[label == k], return_counts=True)
        for w in words[c >= LEXICON_COUNT].tolist():
            lexicons[w] += 1 << k
    chain = Chain(languages, dict(lexicons))
    spans = [np.flatnonzero(np.diff(np.concatenate([[0], document == d, [0]]).astype(np.int8))) for d in np.unique(document)]
    by_lang = [[x for x in spans if label[x[0]] == k] for k in range(len(languages))]
    usable = [k for k, own in enumerate(by_lang) if own]
    if len(usable) < 2:
        return chain
    drawn = []
    for _ in range(SEQUENCES):
        line: list[int] = []
        while len(line) < SEQUENCE_WORDS:
            # most pieces fill the sequence: switches are the exception
            n = SEQUENCE_WORDS - len(line) if rng.random() < 0.7 else int(rng.integers(3, SEQUENCE_WORDS))
            own = by_lang[usable[rng.integers(len(usable))]]
            a, b = own[rng.integers(len(own))]
            at = int(rng.integers(a, max(a + 1, b - n + 1)))
            line += range(at, min(b, at + n))[:SEQUENCE_WORDS - len(line)]
        drawn.append(line)
    drawn = np.array(drawn)
    k = len(languages)
    g_w, g_t = np.full_like(chain.weights, 1e-6), np.full((k, k), 1e-6)
    size = 64
    for _ in range(EPOCHS):
        for at in range(0, len(drawn), size):
            words = drawn[at:at + size].ravel()
            kinds, first = features(data, s[words], e[words], chain.lexicon(h[words]))
            n = len(kinds[0])
            owner = np.repeat(np.arange(len(words)), np.diff(np.append(first, n)))
            emission = sum(np.add.reduceat(chain.weights[x], first, axis=0) for x in kinds)
            gold = label[words]
            lines = len(words) // SEQUENCE_WORDS
            prob, counts = forward_backward(emission.astype(np.float64), chain.steps.astype(np.float64),
                                            np.arange(lines) * SEQUENCE_WORDS, np.full(lines, SEQUENCE_WORDS), count=True)
            error = -prob
            error[np.arange(len(gold)), gold] += 1
            grid = gold.reshape(lines, SEQUENCE_WORDS)
            seen = np.zeros((k, k))
            np.add.at(seen, (grid[:, :-1].ravel(), grid[:, 1:].ravel()), 1)
            # Adagrad, each feature once per batch
            bucket = np.concatenate(kinds)
            of = np.tile(owner, len(kinds))[bucket < BUCKETS]
            bucket = bucket[bucket < BUCKETS]
            grad = np.stack([np.bincount(bucket, weights=error[of, j], minlength=BUCKETS + 1) for j in range(k)], axis=1) / lines
            g_w += (grad ** 2).astype(np.float32)
            chain.weights += (0.1 * grad / np.sqrt(g_w)).astype(np.float32)
            step = (seen - counts) / lines
            g_t += step ** 2
            chain.steps += (0.1 * step / np.sqrt(g_t)).astype(np.float32)
    return chain


def label_words(texts: list[bytes], chain: Chain):
    """(probabilities, document) of every word that has a letter."""
    data = b"\n".join(texts) + b"\n"
    h, s, e = WordHasher(word_bytes()).words(data)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    letter = has_letter(data, s[first], e[first])
    found = chain.emissions(data, h[first], s[first], e[first]) if len(h) else np.zeros((0, len(chain.languages)))
    found = np.where(letter[:, None], found, 0).astype(np.float32)[inverse]
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), s)
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(s) else np.zeros(0, np.int64)
    prob, _ = forward_backward(found, chain.steps, begin, np.diff(np.append(begin, len(s))))
    document = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), s, side="right")
    return prob[letter[inverse]], document[letter[inverse]]


def label_texts(texts: list[bytes], chain: Chain) -> list[dict]:
    """RESULT rows of texts."""
    languages = chain.languages
    prob, document = label_words(texts, chain)
    n = np.bincount(document, minlength=len(texts))
    total = np.stack([np.bincount(document, weights=prob[:, k], minlength=len(texts)) for k in range(len(languages))], axis=1)
    best = total.argmax(axis=1)
    word = prob.argmax(axis=1)
    cut = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (document[1:] != document[:-1]))) if len(word) else np.zeros(0, np.int64)
    stop = np.append(cut[1:], len(word)) if len(word) else cut
    first = np.cumsum(n) - n
    segments: list[list[dict]] = [[] for _ in texts]
    for a, b, d, k in zip(cut.tolist(), stop.tolist(), document[cut].tolist(), word[cut].tolist(), strict=True):
        segments[d].append({"lang": languages[k], "start": int(a - first[d]), "end": int(b - first[d])})
    return [{"lang": languages[best[d]], "score": min(1.0, float(total[d, best[d]] / n[d])), "n_words": int(n[d]), "segments": segments[d]}
            if n[d] else {"lang": UNKNOWN, "score": 0.0, "n_words": 0, "segments": []} for d in range(len(texts))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded training sample: (text, lang), per language the SAMPLE_DOCS least of its different
    (doc_id, text) by a hash, the first SAMPLE_CHARS characters of each. Two scans, whatever the number
    of languages; the first shuffles a hash per document, pre-aggregated."""
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
    usable = docs.where(F.col("lang").isNotNull() & learned & F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), F.col("text")))
    keyed = usable.select("lang", key.alias("key"), "text")
    # the least of each part first: a language's window then holds PARTS * SAMPLE_DOCS keys at most
    least = keyed.groupBy("lang", "key").agg(F.lit(1)).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("key"))
        least = least.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)
    # one row per language
    cuts = {r.lang: r.cut for r in least.groupBy("lang").agg(F.max("key").alias("cut")).collect()}
    if not cuts:
        return []
    cut = F.map_from_arrays(F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts.values())))
    chosen = keyed.where(F.col("key") <= F.try_element_at(cut, F.col("lang"))).select("lang", "key", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    return [(r.text, r.lang) for r in sorted(chosen.dropDuplicates(["lang", "key"]).collect(), key=lambda r: (r.lang, r.key))]


def identify(docs: DataFrame, chain: Chain, name: str = "language") -> DataFrame:
    """``docs`` with a RESULT column ``name`` (or name_1, ... if docs has that): language, mean probability and the runs of words of one language."""
    name = free_name(docs, name)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()),
                      ("segments", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(column):
        if not chain.languages:
            return pa.array([{"lang": UNKNOWN, "score": 0.0, "n_words": 0, "segments": []}] * len(column), type=kind)
        out, group, size = [], [], 0
        texts = bytes_of(column)
        for k, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= BATCH_BYTES or k == len(texts) - 1:
                out.append(pa.array(label_texts(group, chain), type=kind))
                group, size = [], 0
        return pa.concat_arrays(out) if out else pa.array([], type=kind)

    return append_column(docs, name, RESULT, "text", run)


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(sample(docs)), name="l")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"),
                        F.size("l.segments").cast("long").alias("n_segments"))


QUERIES = {"op5_crf_language": op5_crf_language}
