"""Sharding, prefix tries and clusters against brute force, on tricky and on empty tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from seriesloom.llm import centroids, prefix_trie, queries, sharding

# --- sharding -------------------------------------------------------------------


def test_shards_hold_every_record_once(tricky, rows, spark, tmp_path):
    got = sharding.shard_documents(tricky, n_shards=4, slots=256, folder=str(tmp_path)).collect()
    assert Counter((r["record"]["doc_id"], r["record"]["text"]) for r in got) == Counter(rows)
    assert set(got[0]["record"].asDict()) == set(tricky.columns)
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append((r["place"], r["slot"]))
    current = sharding.load_map(spark, str(tmp_path), 2)
    for shard, found in places.items():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        slots = [s for _, s in sorted(found)]
        assert slots == sorted(slots) and all(current.shards[s] == shard for s in slots)


def test_sharding_an_empty_table(empty):
    got = sharding.shard_documents(empty, n_shards=3, slots=16)
    assert got.columns == ["shard", "slot", "place", "record"] and got.count() == 0


def test_a_rebalance_evens_bytes_and_moves_little():
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.pareto(1.5, 4096) * 1000 + 1]
    sizes[7] = 0
    even = sharding.rebalance(sharding.first_map(16, 4096), sizes)
    found = sharding.loads(even, sizes)
    assert max(found) - min(found) < 0.001 * sum(sizes) / 16 or max(found) == max(sizes)
    assert even.shards[7] == 7 and even.version == 2
    sizes[100] += sum(sizes) // 200
    again = sharding.rebalance(even, sizes)
    moved = sum(b for b, x, y in zip(sizes, even.shards, again.shards) if x != y)
    assert moved < 0.02 * sum(sizes)
    assert max(sharding.loads(again, sizes)) < 1.01 * max(max(sizes), sum(sizes) / 16)


def test_growing_moves_slots_into_the_new_shard_only():
    sizes = [(v * 37) % 101 + 1 for v in range(2048)]
    before = sharding.rebalance(sharding.first_map(16, 2048), sizes)
    after = sharding.grow(before, sizes)
    assert all(y == x or y == 16 for x, y in zip(before.shards, after.shards))
    found = sharding.loads(after, sizes)
    assert after.n_shards == 17 and max(found) - min(found) <= 2 * max(sizes)


def test_a_stored_version_is_never_replaced(spark, tmp_path):
    start = sharding.first_map(3, 10)
    sharding.store_map(spark, str(tmp_path), start)
    assert sharding.load_map(spark, str(tmp_path), 1) == start
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.store_map(spark, str(tmp_path), sharding.rebalance(start, [1] * 10)._replace(version=1))


def test_rows_without_an_id_spread_by_text(spark):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(400)], "doc_id long, text string")
    got = Counter(r["shard"] for r in sharding.shard_documents(docs, n_shards=4, slots=64).collect())
    assert len(got) == 4 and max(got.values()) < 200


# --- prefix trie -----------------------------------------------------------------


def brute_trie(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return Counter(
        (
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def ordered(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, digest, r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}


SCHEMA = "conv_id long, turn long, role string, text string, d long, key string, place int, last string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "l") for r in rows], SCHEMA).repartition(5)


def many_turns():
    rows = []
    for c in range(130):
        for t in range(c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else f"say {c % 5 if t < 3 else c} {t} é🙂"))
    rows += [(900 + c, t, "user", f"same {t}") for c in range(40) for t in range(3)]  # copies
    rows += [(c, t, "user", "x" * (t % 11)) for c in (2000, 2001) for t in range(700)]  # long, alike
    rows += [(2002, t, "user", "x" * (t % 11)) for t in range(500)] + [(2002, 500, "user", "differs")]
    rows += [(3000, None, "user", "no turn"), (3000, 1, None, None), (3001, None, "user", "no turn"), (3001, 1, "", "")]
    rows += [(3002, 1, "a", "bc"), (3003, 1, "ab", "c"), (3004, 5, "u", "tie"), (3004, 5, "u", "tie"), (None, 1, "u", "nobody")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = many_turns()
    got = prefix_trie.prefix_trie(talk(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(ordered(rows))


def test_a_sketch_that_proves_nothing_changes_nothing(spark, monkeypatch):
    rows = many_turns()[:300]
    screen = prefix_trie._screen
    monkeypatch.setattr(prefix_trie, "sketch", lambda keys, width: "")

    def no_proof(path, width, pairs, names):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                flags = [pa.array([False] * b.num_rows) for _ in names]
                yield pa.RecordBatch.from_arrays([*b.columns, *flags], names=b.schema.names + names)

        return run

    monkeypatch.setattr(prefix_trie, "_screen", no_proof)
    got = prefix_trie.prefix_trie(talk(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(ordered(rows))
    assert screen is not no_proof


def test_parents_proved_single_of_prefixes_that_are_not(spark):
    """A crowded sketch takes many single prefixes for shared ones, their parents less often."""
    rows = [(c, t, "user", f"own {c} {t}") for c in range(1200) for t in range(4)]
    got = prefix_trie.prefix_trie(talk(spark, rows), widest=4096)
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(ordered(rows))


def test_screen_proves_most_single_prefixes_and_no_shared_one(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id DIV 2 * int(id < 4000) + id * int(id >= 4000)) AS k1", "xxhash64(7, id DIV 2 * int(id < 4000) + id * int(id >= 4000)) AS k2")
    path = prefix_trie.sketch(keys, 1 << 16)
    screen = prefix_trie._screen(path, 1 << 16, [("k1", "k2")], ["single"])
    got = keys.mapInArrow(screen, "k1 long, k2 long, single boolean").groupBy("k1").agg({"single": "max", "*": "count"}).collect()
    assert not any(r["max(single)"] for r in got if r["count(1)"] > 1)
    alone = [r["max(single)"] for r in got if r["count(1)"] == 1]
    assert sum(alone) > 0.9 * len(alone)


def test_rebuilt_conversations(spark):
    rows = [(c, t, r, x) for c, t, r, x in many_turns()] + [(100, 0, "system", "host"), (200, 1, "user", "only one")]
    rows += [(c, 0, "user", f"own {c}") for c in range(201, 240)] + [(-7, 0, "user", "negative")]
    turns, ids = prefix_trie.with_host_turns(talk(spark, rows))
    by = ordered(rows)
    want = {}
    for c, v in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        host = c - int(np.fmod(c, 100))
        want[c] = by.get(host, [])[:h] + v[h:]
    got = defaultdict(list)
    for r in turns.collect():
        got[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    assert {r[0] for r in ids.collect()} == set(want) and ids.count() == len(want)
    for c, v in want.items():
        assert sorted(got[c]) == [(k, *x) for k, x in enumerate(v)]
    tree = prefix_trie.prefix_trie(turns, ids)
    assert Counter(tuple(r) for r in tree.collect()) == brute_trie(want)


def test_tries_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(talk(spark, [])).count() == 0
    ids = spark.createDataFrame([(4,), (2,), (4,), (None,)], "conv_id long")
    got = [tuple(r) for r in prefix_trie.prefix_trie(talk(spark, []), ids).collect()]
    assert got == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]


# --- clusters --------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, seed=2):
    kept = [
        (i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return found, centres


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "c", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, ids string, d int"
    ).repartition(3)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 1, 4)]) for k in range(300)]
    rows += [(1000 + k, [0.5, 0.25, -0.125, 0.0]) for k in range(200)]  # copies
    rows += [(9, rows[9][1]), (None, [1.0, 1.0, 1.0, 1.0]), (400, None), (401, []), (402, [1.0] * 3), (403, [1.0] * 5)]
    rows += [(404, [1.0, None, 1.0, 1.0]), (405, [float("nan")] + [1.0] * 3), (406, [float("inf")] + [1.0] * 3)]
    got = centroids.cluster(vectors(spark, rows), k=12, rounds=4, dims=4).collect()
    want, centres = brute_clusters(rows, 12, 4, 4)
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    per = Counter()
    for _, c, d in want:
        per[c] += d
    for r in got:
        assert r["centroid"] == centres[r["cluster"]]
        assert r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values())


def test_few_none_and_large_vectors(spark):
    assert centroids.cluster(vectors(spark, [(1, [1.0])])).count() == 0
    got = centroids.cluster(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), k=40, dims=2).collect()
    assert {(r["id"], r["cluster"], r["distance"]) for r in got} == {(1, 0, 0), (2, 0, 0)}
    rows = [(k, [float(2 ** (20 + k)), -float(2 ** (30 - k))]) for k in range(6)]
    got = centroids.cluster(vectors(spark, rows), k=3, rounds=3, dims=2).collect()
    want, _ = brute_clusters(rows, 3, 3, 2)
    assert {(r["id"], r["cluster"], r["distance"]) for r in got} == {(i, c, d if d < 2**63 else None) for i, c, d in want}
    nobody = centroids.cluster(vectors(spark, [(None, [1.0, 2.0])]), dims=2).collect()
    assert [(r["id"], r["cluster"]) for r in nobody] == [(None, None)]


# --- queries against their SQL -----------------------------------------------------


@pytest.mark.parametrize("name", ["op11_virtual_slots", "op12_prefix_trie", "op13_integer_clusters"])
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(rel.columns)
    assert Counter(tuple(r) for r in got.select(*rel.columns).collect()) == Counter(rel.fetchall())
