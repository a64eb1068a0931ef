"""Benchmark decontamination by suffix arrays over the training texts.

Every task cuts its documents into shards of about ``shard_words`` words and builds, for each, a
sorted array of word suffixes. Every different window that begins an item suffix is
binary-searched in it, narrowing a range word by word; the range found at the window's length
holds all places of that window. A place's longest verbatim match is with one of the two item suffixes
beside it in sorted order, found by binary search among those that begin with its window. ``matches`` lists
each longest match that no match one word earlier covers, once, with one item that has it; ``items`` has
all. Work is in proportion to places and windows, never to their product.

The array is sparse: words that no item has can't be part of a match, so they get number 0, and
only suffixes that begin with as many item words as the shortest window are sorted. Nothing that
could match is left out. Documents are read once and never shuffled; a document longer than a shard
is searched in pieces that overlap by the longest item.

The benchmark is the stated query set. It reaches the tasks in blocks of about ``block_bytes``
(its size is measured first); each further block is one more pass over the texts in the same job.

Words are compared by 64-bit hash, runs beyond a window by two sums modulo 2^31 - 1. Nulls: a null text has no words; a null item_id counts as ''.
An empty benchmark leaves every document clean. Repeated document rows each give their own row;
repeated items count once by their id. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.llm.common import ALNUM_WORD, LOWER, UPPER, WordHasher, alnum_bytes, append_column, bytes_of, free_name, table

WINDOW = 10                    # words of a window
SHARD_WORDS = 1_000_000        # words of one suffix array
BLOCK_BYTES = 16 << 20         # benchmark text searched in one pass
MODULUS = (1 << 31) - 1        # of the sums that compare runs of words, with
BASES = (1_103_515_245, 69_069_069)

MATCH = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_start", T.IntegerType()),
                      T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("items", T.ArrayType(T.StringType())),
                       T.StructField("spans", T.ArrayType(SPAN)),
                       T.StructField("matches", T.ArrayType(MATCH))])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ("matches", pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int32()),
                                                    ("start", pa.int32()), ("length", pa.int32())])))])


@dataclass
class TestSet:
    """A block of items as numbered words. Equal windows are one class; the places of a class (``at`` and
    what goes with it) lie together, sorted by the item suffixes that begin there."""
    vocabulary: np.ndarray         # sorted word hashes; word number = index + 1
    words: np.ndarray              # all items' word numbers, 0 after each item
    run: np.ndarray                # words from each place to the end of its item
    sums: list[np.ndarray]         # prefix sums of ``words`` (``prefix_sums``)
    at: np.ndarray                 # per window: index in ``words`` at which it begins
    offset: np.ndarray             # the same within its item
    text: np.ndarray               # which distinct item text it belongs to
    first: np.ndarray              # per class: its first window; one more entry for the end
    width: np.ndarray              # per class: words of a window
    ids: list[list[str]]           # item ids of each distinct text
    longest: int                   # words of the longest item


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo ``MODULUS``, or some more."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), MODULUS) % MODULUS])
    return out


def prefix_sums(words: np.ndarray) -> list[np.ndarray]:
    """Per base, sums of word * base^place modulo ``MODULUS`` over the words before each place."""
    out = []
    for base in BASES:
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(words * powers(base, len(words))[:len(words)] % MODULUS, out=total[1:])
        out.append(total % MODULUS)
    return out


def suffix_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` words or more, by doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:len(rank) - k] = rank[k:] + 1
        distinct, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        k *= 2
        if len(distinct) == len(rank):
            break
    return rank


def test_set(items: list[tuple[str, str]], window: int) -> TestSet:
    hasher = WordHasher(alnum_bytes())
    by_words: dict[bytes, list[str]] = {}
    hashed: list[np.ndarray] = []
    for item, text in items:
        h = hasher.words(text.encode())[0]
        if not len(h):
            continue
        if h.tobytes() not in by_words:
            hashed.append(h)
        by_words.setdefault(h.tobytes(), []).append(item)
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
    words, run, at, offset, width, text = [], [], [], [], [], []
    base = 0
    for k, h in enumerate(hashed):
        w = min(window, len(h))
        n = len(h) - w + 1
        words += [np.searchsorted(vocabulary, h) + 1, np.zeros(1, np.int64)]
        run.append(np.arange(len(h), -1, -1))
        at.append(np.arange(base, base + n))
        offset.append(np.arange(n))
        width.append(np.full(n, w))
        text.append(np.full(n, k))
        base += len(h) + 1
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    words, run, at, offset, width, text = map(cat, (words, run, at, offset, width, text))
    longest = max(map(len, hashed), default=0)
    # the class of a window: its words, 0 where it has ended
    of_class = np.zeros(len(at), np.int64)
    padded = np.concatenate([words, np.zeros(window, np.int64)])
    for d in range(window):
        word = np.where(d < width, padded[at + d], 0)
        of_class = np.unique(of_class * (len(vocabulary) + 1) + word, return_inverse=True)[1].astype(np.int64)
    by = np.lexsort((suffix_ranks(words, longest + 1)[at], of_class))
    at, offset, width, text, of_class = at[by], offset[by], width[by], text[by], of_class[by]
    first = np.append(np.flatnonzero(np.diff(of_class, prepend=-1)), len(at))
    return TestSet(vocabulary, words, run, prefix_sums(words), at, offset, text, first, width[first[:-1]],
                   [sorted(set(x)) for x in by_words.values()], longest)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` words from each on (``ids`` is padded with that many 0s).

    Most significant words first, several packed in a key; only groups that are still tied are
    sorted again by their next words.
    """
    bits = max(1, int(ids.max(initial=0)).bit_length())
    per_key = max(1, 62 // bits)
    order, tied = starts, np.ones(len(starts), dtype=bool)
    group = np.zeros(len(starts), dtype=np.int64)
    for d in range(0, depth, per_key):
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = order[slots]
        key = np.zeros(len(pos), dtype=np.int64)
        for k in range(d, min(d + per_key, depth)):
            key = (key << bits) | ids[pos + k]
        by = np.lexsort((key, group[slots])) if d else np.argsort(key, kind="stable")
        pos, key, g = pos[by], key[by], group[slots][by]
        if d == 0:
            order = order.copy()
        order[slots] = pos
        new = np.ones(len(pos), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group[slots] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        last = np.append(new[1:], True)
        tied[slots] = ~(new & last)
    return order


def _bound(ids, order, lo, hi, depth, target, right):
    """Per query, the first index in [lo, hi) whose word at ``depth`` is not below (right: above) the target."""
    lo, hi = lo.copy(), hi.copy()
    while (busy := lo < hi).any():
        mid = (lo + hi) >> 1
        word = ids[order[np.minimum(mid, len(order) - 1)] + depth]
        up = busy & ((word <= target) if right else (word < target))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(busy & ~up, mid, hi)
    return lo


def find_in_shard(ids: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, place, words of the longest match from there, window that it matches) for all classes of windows found
    in ``ids``, the shard's word numbers with a 0 after each document. A place has at most one class of each width."""
    none = np.zeros(0, np.int64)
    if not len(tests.at) or not len(ids):
        return none, none, none, none
    shortest = int(tests.width.min())
    zeros = np.flatnonzero(ids == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(ids)))] - np.arange(len(ids))
    starts = np.flatnonzero(run >= shortest)
    if not len(starts):
        return none, none, none, none
    padded = np.concatenate([ids, np.zeros(tests.longest + 1, np.int64)])
    order = suffix_array(padded, starts, int(tests.width.max()))
    begin = tests.at[tests.first[:-1]]
    lo = np.zeros(len(begin), np.int64)
    hi = np.full(len(begin), len(order), np.int64)
    alive = np.arange(len(begin))
    for d in range(int(tests.width.max())):
        alive = alive[(tests.width[alive] > d) & (lo[alive] < hi[alive])]
        target = tests.words[begin[alive] + d]
        a, b = lo[alive], hi[alive]
        lo[alive] = _bound(padded, order, a, b, d, target, False)
        hi[alive] = _bound(padded, order, lo[alive], b, d, target, True)
    count = hi - lo
    found = np.repeat(np.arange(len(count)), count)
    place = order[np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    if not len(found):
        return none, none, none, none
    return found, place, *_longest(padded, run, tests, found, place)


def _longest(padded: np.ndarray, run: np.ndarray, tests: TestSet, found: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, window) of the longest match of each place with the windows of its class: one of the two item
    suffixes beside it in their sorted order, which a binary search finds."""
    sums = prefix_sums(padded[:len(run)])
    power = [powers(base, max(len(run), len(tests.words))) for base in BASES]

    def common(k: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Words that place k and the window's suffix have in common, by bisection over prefix sums."""
        p, o = place[k], tests.at[window]
        low, high = tests.width[found[k]].copy(), np.minimum(run[p], tests.run[o])
        while len(busy := np.flatnonzero(low < high)):
            a, b = p[busy], o[busy]
            mid = (low[busy] + high[busy] + 1) >> 1
            same = np.ones(len(busy), dtype=bool)
            for mine, theirs, pw in zip(sums, tests.sums, power, strict=True):
                same &= (mine[a + mid] - mine[a]) % MODULUS * pw[b] % MODULUS == (theirs[b + mid] - theirs[b]) % MODULUS * pw[a] % MODULUS
            low[busy] = np.where(same, mid, low[busy])
            high[busy] = np.where(same, high[busy], mid - 1)
        return low

    first, last = tests.first[found], tests.first[found + 1]
    lo, hi = first.copy(), last.copy()
    while len(k := np.flatnonzero(lo < hi)):
        mid = (lo[k] + hi[k]) >> 1
        n = common(k, mid)
        up = tests.words[tests.at[mid] + n] <= padded[place[k] + n]
        lo[k] = np.where(up, mid + 1, lo[k])
        hi[k] = np.where(up, hi[k], mid)
    every = np.arange(len(place))
    below, above = np.maximum(lo - 1, first), np.minimum(lo, last - 1)
    n_below, n_above = common(every, below), common(every, above)
    better = n_above > n_below
    return np.where(better, n_above, n_below), np.where(better, above, below)


def _maximal(place: np.ndarray, length: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of each place, less those that the match of the place before covers."""
    by = np.lexsort((window, -length, place))
    by = by[np.diff(place[by], prepend=-1) > 0]
    place, length, window = place[by], length[by], window[by]
    covered = np.append(False, (place[1:] == place[:-1] + 1) & (length[:-1] > length[1:]))
    return place[~covered], length[~covered], window[~covered]


def _shards(hashed: list[np.ndarray], shard_words: int, overlap: int):
    """Lists of (row, first word, words before the first that count, hashes), about shard_words words each."""
    shard, size = [], 0
    for row, h in enumerate(hashed):
        for first in range(0, len(h), shard_words):
            before = min(1, first)
            shard.append((row, first, before, h[first - before:first + shard_words + overlap]))
            size += len(shard[-1][3])
            if size >= shard_words:
                yield shard
                shard, size = [], 0
    if shard:
        yield shard


def _merged(first: np.ndarray, last: np.ndarray) -> list[dict]:
    """The union of half-open ranges."""
    by = np.argsort(first, kind="stable")
    first, reach = first[by], np.maximum.accumulate(last[by])
    new = np.append(True, first[1:] > reach[:-1])
    return [{"start": int(a), "end": int(b)} for a, b in
            zip(first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)], strict=True)]


def search_batch(texts: list[bytes], tests: TestSet, shard_words: int) -> list[dict]:
    """RESULT rows of one batch of documents."""
    hasher = WordHasher(alnum_bytes())
    hashed, at, group, size = [], 0, [], 0
    for k, text in enumerate(texts):       # short texts are hashed together
        group.append(text)
        size += len(text) + 1
        if size >= 1 << 21 or k == len(texts) - 1:
            h, start, _ = hasher.words(b"\n".join(group) + b"\n")
            cuts = np.searchsorted(start, np.cumsum([len(t) + 1 for t in group]))
            hashed += np.split(h, cuts[:-1])
            at, group, size = k + 1, [], 0
    out = [{"n_words": len(h), "n_hit": 0, "items": [], "spans": [], "matches": []} for h in hashed]
    for shard in _shards(hashed, shard_words, tests.longest):
        joined = np.concatenate([x for _, _, _, h in shard for x in (h, np.zeros(1, np.uint64))])
        base = np.cumsum([0] + [len(h) + 1 for *_, h in shard])
        ids = np.searchsorted(tests.vocabulary, joined)
        known = np.zeros(len(ids), dtype=bool)
        if len(tests.vocabulary):
            ids = np.minimum(ids, len(tests.vocabulary) - 1)
            known = tests.vocabulary[ids] == joined
        known[base[1:] - 1] = False
        ids = np.where(known, ids + 1, 0)
        found, place, length, window = find_in_shard(ids, tests)
        if not len(found):
            continue
        part = np.searchsorted(base, place, side="right") - 1
        local = place - base[part]
        top = _maximal(place, length, window)
        top_part = np.searchsorted(base, top[0], side="right") - 1
        top_local = top[0] - base[top_part]
        for k in np.unique(part):
            row, first, before, h = shard[k]
            mine = (part == k) & (local >= before) & (local < before + shard_words)
            if not mine.any():
                continue
            start = local[mine] + first - before
            r = out[row]
            hit = np.unique(found[mine])
            count = tests.first[hit + 1] - tests.first[hit]
            entries = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(tests.first[hit], count)
            r["items"] = sorted(set(r["items"]).union(*(tests.ids[t] for t in np.unique(tests.text[entries]))))
            old = r["spans"]
            r["spans"] = _merged(np.append(start, [s["start"] for s in old]).astype(np.int64),
                                 np.append(start + tests.width[found[mine]], [s["end"] for s in old]).astype(np.int64))
            own = (top_part == k) & (top_local >= before) & (top_local < before + shard_words)
            r["matches"] += [{"item": tests.ids[tests.text[w]][0], "item_start": int(tests.offset[w]), "start": int(s), "length": int(n)}
                             for s, n, w in zip(top_local[own] + first - before, top[1][own], top[2][own], strict=True)]
    for r in out:
        r["n_hit"] = sum(s["end"] - s["start"] for s in r["spans"])
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int):
    """The items, dealt by hash into blocks of about ``block_bytes``; one block at a time is fetched."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item, r.text) for r in items.where(block == k).collect()]


def longest_matches(docs: DataFrame, benchmark: DataFrame, name: str = "contamination", window: int = WINDOW,
                    shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a RESULT column ``name`` (or name_1, ... if docs has that): hit words, items, hit spans and the longest verbatim
    matches with their places (word offsets)."""
    name = free_name(docs, name)
    out, parts = docs, []
    for items in benchmark_blocks(benchmark, block_bytes):
        tests = test_set(items, window)

        def run(column, tests=tests):
            return pa.array(search_batch(bytes_of(column), tests, shard_words), type=_ARROW)

        parts.append(free_name(out, f"{name}_block"))
        out = append_column(out, parts[-1], RESULT, "text", run)
    if len(parts) == 1:
        return out.withColumnRenamed(parts[0], name)
    both = lambda f: F.flatten(F.array(*[F.col(p)[f] for p in parts]))
    union = F.aggregate(
        F.array_sort(both("spans")), F.array().cast(T.ArrayType(SPAN)),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    hit = F.aggregate(union, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    result = F.struct(F.col(parts[0])["n_words"].alias("n_words"), hit.alias("n_hit"),
                      F.array_sort(F.array_distinct(both("items"))).alias("items"), union.alias("spans"),
                      both("matches").alias("matches"))
    return out.withColumn(name, result).drop(*parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    name = free_name(docs, "contamination")
    found = longest_matches(docs, benchmark, name=name, **kw)
    return found.where(F.col(name)["n_hit"] == 0).drop(name)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = longest_matches(docs, table(spark, sf_dir, "benchmark"), name="c")
    c = F.col("c")
    longest = F.coalesce(F.array_max(F.transform(c["matches"], lambda m: m["length"])), F.lit(0))
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
        longest.cast("long").alias("longest_match"))


QUERIES = {"op1_suffix_array": op1_suffix_array}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}')"
ORACLE_SQL = {"op1_suffix_array": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win0 AS (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(0, len(w) - least({WINDOW}, len(w)) + 1)) AS i
         FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS gram FROM win0),
grams0 AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i
           FROM d, (SELECT DISTINCT k FROM win) AS ks WHERE len(w) >= k),
grams AS (SELECT doc_id, w, k, i, array_to_string(w[i + 1:i + k], ' ') AS gram FROM grams0),
found AS (SELECT g.doc_id, g.w, g.i, g.k, win.item FROM grams g JOIN win ON win.k = g.k AND win.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id),
ext0 AS (SELECT DISTINCT f.doc_id, f.w, f.i, b.w AS t, unnest(range(0, len(b.w))) AS o FROM found f JOIN b ON b.item = f.item),
ext AS (SELECT doc_id, w, i, t, o FROM ext0 WHERE o + {WINDOW} <= len(t) OR (o = 0 AND len(t) < {WINDOW})),
longest AS (SELECT doc_id, max(n) AS longest FROM (
    SELECT doc_id, len(list_filter(range(1, least(len(w) - i, len(t) - o) + 1), lambda n: w[i + 1:i + n] = t[o + 1:o + n])) AS n
    FROM ext WHERE w[i + 1] = t[o + 1] AND w[i + 1:i + least({WINDOW}, len(t))] = t[o + 1:o + least({WINDOW}, len(t))]) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit,
       coalesce(items.n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated, coalesce(longest.longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)"""}
