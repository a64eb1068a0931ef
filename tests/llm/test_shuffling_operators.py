"""Mixing, sharding, archives and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from io import BytesIO

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setscore.llm import contamination, line_quality, mixing, sharding, warc
from setscore.llm.common import shared_folder
from tests.conftest import SF0001
from tests.llm.conftest import ROWS
from tests.llm.test_simhash import brute_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- mixing -------------------------------------------------------------------------------------

def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return out


def check_mix(rows, plan):
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    assert len(plan) == len(rows)
    taken, largest = Counter(), 0
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(targets[r.source])) and 0 <= r.times <= 2
        taken[r.source] += r.size * r.times
        largest = max(largest, r.size)
    total = sum(sizes.values())
    assert total * 1.5 - 2 * largest * len(sizes) <= sum(taken.values()) <= total * 1.5
    for s in sizes:
        assert abs(taken[s] - float(targets[s])) <= 2 * largest
    return taken


def test_mix_of_odd_rows(spark, odd):
    plan = mixing.mix_plan(odd).collect()
    check_mix(ROWS, plan)
    assert sorted(map(tuple, mixing.mix_plan(odd.repartition(5)).collect()), key=str) == sorted(map(tuple, plan), key=str)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) == +Counter(
        {k: n for k, n in _times(plan, odd).items()})
    assert mixing.mix_plan(odd.where("false")).collect() == [] and mixing.mixed(odd.where("false")).collect() == []


def _times(plan, odd) -> Counter:
    """How often each (doc_id, text) is taken; in these rows (doc_id, source, size) tells texts apart."""
    text = {(r.doc_id, r.source, len(WORD.findall(r.text or ""))): r.text for r in odd.select("doc_id", "source", "text").collect()}
    out: Counter = Counter()
    for r in plan:
        out[r.doc_id, text[r.doc_id, r.source, r.size]] += r.times
    return out


def test_mix_with_small_buckets_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "RUN", 3)
    rows = [(i, "w " * (i % 13 + 1), None, f"s{i % 5}" if i % 2 else "s0", 0) for i in range(300)] + [(7, "hot row", None, "s0", 0)] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_mix(rows, mixing.mix_plan(df).collect())


# -- sharding -----------------------------------------------------------------------------------

def test_shards_of_odd_rows(spark, odd):
    got = sharding.shuffled(odd, shards=4, bucket_bytes=10_000).select("record.doc_id", "record.text", "shard", "slot", "size").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in ROWS)
    assert all(r.size == len((r.text or "").encode()) + 16 for r in got)
    for s in {r.shard for r in got}:
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shuffled(odd.where("false")).collect() == []


def test_law_order_and_reruns(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = sharding.op7_external_shuffle(spark, SF0001).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "key" and 0 <= r.shard < 40 for r in rows)
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and len({r.shard for r in rows}) > 30
    assert sorted(map(tuple, sharding.op7_external_shuffle(spark, SF0001).collect())) == sorted(map(tuple, rows))
    one = sharding.shuffled(docs, shards=1).select("record.doc_id", "slot").orderBy("slot").collect()
    order = [r.doc_id for r in one]
    assert order != sorted(order)
    # of a random permutation, about half of the neighbours ascend
    assert 0.35 < sum(a < b for a, b in zip(order, order[1:])) / len(order) < 0.65


def test_shards_spread_evenly_and_are_written(spark):
    df = spark.range(4_000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    n = Counter(r.shard for r in sharding.shuffled(df, shards=8, bucket_bytes=5_000).select("shard").collect())
    assert min(n.values()) > 400 and max(n.values()) < 600
    path = shared_folder(spark, "test-shards") + "/out"
    sharding.write_shards(df.selectExpr("*", "'mine' AS Shard", "id AS slot") if "id" in df.columns else df.selectExpr("*", "'mine' AS Shard", "1 AS slot"), path, shards=8, bucket_bytes=5_000)
    assert spark.read.parquet(path).groupBy("shard").agg(F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).where("d <> m + 1").count() == 0


# -- archives -----------------------------------------------------------------------------------

PAGES = [(0, "http://a/é\r\nX: y", "<p>é</p>", "x"), (1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>é</p>", "x"), (3, "u", "<p>é</p>", "x"),
         (None, "n", "<p>é</p>", "x"), (None, "n", "only", "x"), (9, "big", "WARC/1.1\r\n\r\n" * 60_000, "x")] + [(20 + i, f"u{i}", f"<html>{i}</html>" * 30, "x") for i in range(300)]


def test_archive_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, first_id string").withColumn("digest", F.lit(1)).repartition(3)
    folder = shared_folder(spark, "test-warc")
    manifest = warc.write_archives(df, folder)
    got = warc.read_archives(manifest, folder).collect()
    assert sum(r.records for r in manifest.collect()) == len(got) == len(PAGES)
    first = {}
    for i, _, h, _ in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter((i, len((h or "").encode()), first.get(h or "") if first.get(h or "") not in (None, i) else None) for i, _, h, _ in PAGES)
    assert Counter((r.page_id, r.payload_bytes, r.refers_to) for r in got) == want
    by_id = {i: h or "" for i, _, h, _ in PAGES if i is not None}
    for r in got:
        assert (r.record_type == "response") == (r.refers_to is None)
        if r.record_type == "response" and r.page_id is not None:
            assert r.payload.decode() == by_id[r.page_id] and "\n" not in r.url
    # many small archives are many tasks
    many = [warc.write_archives(df.where(f"page_id % 5 = {k}"), folder) for k in range(5)]
    many = many[0].unionByName(many[1]).unionByName(many[2]).unionByName(many[3]).unionByName(many[4])
    read = warc.read_archives(many, folder)
    tasks = read.select(F.spark_partition_id().alias("t"), "page_id").distinct().groupBy("t").count().count()
    assert read.rdd.getNumPartitions() == many.count() >= 5 and tasks == many.count()
    empty = warc.write_archives(df.where("false"), folder)
    assert warc.read_archives(empty, folder).collect() == []


def test_archive_format_and_damage():
    sink = BytesIO()
    records = [warc.record(i, f"http://x/{i}", f"page {i} {'lorem ipsum ' * (i % 40)}{hashlib.md5(str(i).encode()).hexdigest()}".encode() * 12, None, False) for i in range(2_000)]
    n, size = warc.write_archive(iter(records), sink)
    data = sink.getvalue()
    assert n == 2_000 and size == len(data) < sum(map(len, records)) / 3
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.read_archive(BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        warc.parse(records[3].replace(b"page 3", b"page 4"))


# -- pipeline -----------------------------------------------------------------------------------

def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = docs.collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    good = stages["quality"](spark, docs, SF0001)
    want = {(r.doc_id, j["clean_text"]) for r in rows if (j := line_quality.judge(r.text or "", 0.5))["kept"]}
    assert {(r.doc_id, r.text) for r in good.collect()} == want and good.columns == docs.columns

    one = stages["near_duplicates"](spark, good, SF0001)
    pairs = sorted(want)
    assert {r.doc_id for r in one.collect()} == {c for *_, c in brute_classes(pairs)} and one.columns == docs.columns

    kept = {r.doc_id: r.text for r in one.collect()}
    grams = {tuple(w[i:i + min(10, len(w))]) for _, t in items if (w := words_of(t)) for i in range(len(w) - min(10, len(w)) + 1)}
    clean = stages["decontamination"](spark, one, SF0001)
    assert {r.doc_id for r in clean.collect()} == {d for d, t in kept.items() if not any(
        tuple(w[i:i + len(g)]) == g for w in [words_of(t)] for k in {len(g) for g in grams} for i in range(len(w) - k + 1) for g in [tuple(w[i:i + k])] if g in grams)}

    mix = stages["mixing"](spark, clean, SF0001)
    assert mix.columns == docs.columns and set(Counter(r.doc_id for r in mix.collect()).values()) <= {1, 2}
    last = stages["sharding"](spark, mix, SF0001)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in mix.collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF0001).collect()) == Counter(r.doc_id for r in mix.collect())


def words_of(t: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(contamination.UPPER, contamination.LOWER)))


def test_pipeline_of_odd_rows(spark, odd):
    bench = SF0001
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, bench)
        assert docs.columns == odd.columns, name
        docs = corpus_pipeline.materialise(docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), bench).collect() == []
    last = dict(corpus_pipeline.STAGES)["sharding"](spark, odd, bench)
    assert sorted(last.columns) == sorted(odd.columns) and last.count() == len(ROWS)
    assert last.schema["shard"].dataType.typeName() == "integer" and last.where("slot IS NULL").count() == 0


def test_rows_of_one_doc_id_spread_over_the_order(spark, monkeypatch):
    """A hot doc_id with many texts: its rows lie in many buckets, and the mix takes each as it would others."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    df = spark.createDataFrame([(7, f"text number {i} of one id", "a", "s") for i in range(1000)] + [(None, f"no id {i}", "a", "s") for i in range(500)],
                               "doc_id long, text string, lang string, source string")
    keys = {r.key[:2] for r in mixing.finish_times(df).select("key").collect()}
    assert len(keys) > 200
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == 1500 and abs(sum(r.size * r.times for r in plan) - 1.5 * sum(r.size for r in plan)) <= 2 * 6
