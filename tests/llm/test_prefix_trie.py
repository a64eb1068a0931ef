"""Prefix trie against a plain-Python trie."""

import hashlib
import random

from setscore.llm import prefix_trie

DDL = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is None:
            continue
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        own.setdefault(conv_id, []).append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    members, ended = {}, {}
    for c, turns in own.items():
        h = prefix_trie.borrowed_turns(c)
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        full = tuple(own.get(family, [])[:h] + turns[h:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
        ended.setdefault(full, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ended.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "ROWS", 4)
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "ü"]))
            for c in rnd.sample(range(60), 45) for t in range(rnd.randint(1, 11))]
    rnd.shuffle(rows)
    assert found(prefix_trie.trie(spark.createDataFrame(rows, DDL).repartition(5))) == brute(rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    long = "word " * 40_000
    rows = [(0, None, "user", "null turn first"), (0, 0, None, None), (0, 1, "user", ""), (0, 1, "", "user"), (0, 1, "user", ""), (1, 5, "user", long),
            (1, 7, "x", "y"), (2, 0, "user", "only own turn"), (7, 0, "user", "no conversation 5"), (None, 0, "user", "no id"), (-3, 0, "user", "negative"),
            (-3, 1, "user", "more"), (25, 0, "user", long), (26, 0, "user", long), (27, 3, None, long)]
    docs = spark.createDataFrame(rows, DDL).selectExpr("*", "'x' AS key", "'x' AS chain", "1 AS depth", "'x' AS family", "1L AS size")
    assert found(prefix_trie.trie(docs)) == brute(rows)


def test_a_family_of_copies_and_an_empty_table(spark):
    rows = [(c * 5, t, "user", "the same") for c in range(300) for t in range(4)]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, DDL)))
    assert got == brute(rows) and len(got) == 5 and got[0][3] == 300
    assert prefix_trie.trie(spark.createDataFrame([], DDL)).collect() == []


def test_long_conversations_merge_at_few_depths(spark):
    long = [(f"t{k}", f"x{k % 7}") for k in range(400)]
    rows = [(5 * c, t, r, x) for c in range(3) for t, (r, x) in enumerate(long)]
    rows += [(15, t, r, x) for t, (r, x) in enumerate(long[:250])] + [(20, t, r, x + ("!" if t >= 300 else "")) for t, (r, x) in enumerate(long)]
    df = spark.createDataFrame(rows, DDL)
    assert prefix_trie.merging_depths(prefix_trie.rebuilt(df)) == [300, 250, 0]
    assert found(prefix_trie.trie(df)) == brute(rows)
