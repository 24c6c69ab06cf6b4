"""Near copies, toxicity, decontamination, mixing, archives and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from seriesloom.llm import decontaminate, mixing, simhash, toxicity, warc
from seriesloom.llm.components import components
from seriesloom.llm.text import shingle_hashes, words

from .conftest import BASE


def groups_of(fps, bits):
    """Smallest id reachable over fingerprints within the bits, by comparing all."""
    values = sorted({f for _, f in fps})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= bits:
                parent[find(b)] = find(a)
    low = {}
    for i, f in fps:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [low.get(find(f)) for _, f in fps]


def test_simhash_of_tricky_rows(tricky, rows):
    fps = []
    for i, t in rows:
        h = shingle_hashes(words((t or "").encode()), 4).tolist()
        fps.append((i, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0))
    want = Counter((i, f, g) for (i, f), g in zip(fps, groups_of(fps, 4)))
    got = Counter((r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(tricky).collect())
    assert got == want


@pytest.mark.parametrize("block", [3, 4096])
def test_links_connect_all_pairs_within_four_bits(spark, block):
    rng = np.random.default_rng(block)
    values = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**63))
        for _ in range(25):
            v = centre
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    fps = [(k, v) for k, v in enumerate(sorted(values))]
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for _, v in fps], "fp long")
    got = {r.node % 2**64: r.component % 2**64 for r in components(simhash.links(frame, block=block)).collect()}
    want = groups_of(fps, 4)
    by_want, by_got = {}, {}
    for (k, v), g in zip(fps, want):
        by_want.setdefault(g, set()).add(v)
        by_got.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in components(path).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components(path.limit(0)).count() == 0


def test_keep_one_keeps_one_of_each_group(tricky, spark):
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    # 1, 2 are equal; 3, 4, 7 have no words; 10, 11 near; the copies of 13 are one, its other text stays; 5, 6 equal.
    assert got == Counter([1, 3, 5, 8, 9, 10, 12, 13, 13, 14, None, 15, 16])


def test_keep_one_against_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(30):
        base = [f"g{g}w{int(x)}" for x in rng.integers(0, 400, 250)]
        texts.append(base)
        for edits in (1, 2, 4):
            copy = list(base)
            for at in rng.choice(250, edits, replace=False):
                copy[at] = "changed"
            texts.append(copy)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [set(shingle_hashes(words(t.encode()), 5).tolist()) for _, t in docs]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for a in range(len(docs)):
        for b in range(a):
            alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if alike >= 0.85:
                assert not (a in kept and b in kept), (a, b, alike)
    assert kept >= {k for k in range(0, len(docs), 4)}  # the first of each group


def test_keep_one_at_the_edge_of_the_resemblance(spark):
    """400 isolated pairs of known resemblance: from 0.8 on one goes, below both stay."""
    def resemblance(a, b):
        a, b = (set(shingle_hashes(words(t.encode()), 5).tolist()) for t in (a, b))
        return len(a & b) / len(a | b)

    docs, alike = [], []
    for k in range(400):
        base = [f"p{k}w{j}" for j in range(301)]  # 297 shingles; 33 of them changed are a resemblance of exactly 0.8
        changed = 32 + k // 4 % 3 if k % 4 == 0 else 25 + k % 60
        other = base[: 301 - changed] + [f"p{k}x{j}" for j in range(changed)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        alike.append(resemblance(docs[-2][1], docs[-1][1]))
    assert sum(0.8 <= a < 0.85 for a in alike) > 50 and sum(0.6 <= a < 0.8 for a in alike) > 200
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {i for k, a in enumerate(alike) for i in ((2 * k,) if a >= 0.8 else (2 * k, 2 * k + 1))}


def test_keep_one_finds_copies_by_simhash_alone(spark, monkeypatch):
    """Without any band, pairs within four bits are still linked, and only at the resemblance."""
    monkeypatch.setattr(simhash, "PHASES", (1,))
    docs = []
    for k in range(40):
        base = [f"s{k}w{j}" for j in range(900)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], "changed"]))]
    fps = [simhash.simhash(shingle_hashes(words(t.encode()), 5)) for _, t in docs]
    near = {2 * k + 1 for k in range(40) if (fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= 4}
    assert len(near) > 20
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in docs} - near


@pytest.mark.parametrize("rows, size", [(3, 1_000_000), (1024, 300)])
def test_keep_one_with_crowded_keys(spark, monkeypatch, rows, size):
    monkeypatch.setattr(simhash, "RUN_ROWS", rows)
    monkeypatch.setattr(simhash, "RUN_BYTES", size)
    base = [f"w{j}" for j in range(120)]
    docs = [(k, " ".join([*base, f"end{k}"])) for k in range(20)] + [(50, " ".join(base[:60] + ["other"] * 60))]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 50]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.queries()["op4_toxic_neighbours"](spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and len(got) == 10_000
    hit = sum(got[i].predicted for i, y in held if y)
    false = sum(got[i].predicted for i, y in held if not y)
    assert hit >= 0.85 * sum(y for _, y in held) and false <= 0.03 * len(held)
    assert np.mean([(got[i].score - y) ** 2 for i, y in held]) < 0.04


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    model = toxicity.Model({str(k).encode(): k for k in range(40)}, np.ones(40), 0.1)
    rows, dense = [], []
    for k in range(700):
        terms, weight = model.vector({int(t): int(n) for t, n in zip(rng.choice(40, 5, replace=False), rng.integers(1, 4, 5))})
        rows.append((k, float(k % 2), float(1 - k % 2), terms, weight))
    model.build(rows)
    by_name = {r[0]: r for r in rows}
    for name in model.named:
        v = np.zeros(40)
        v[by_name[name][3]] = by_name[name][4]
        dense.append(v)
    dense = np.array(dense)
    queries = [model.vector({int(t): 1 for t in rng.choice(40, 4, replace=False)}) for _ in range(50)]
    for (terms, weight), (at, sims) in zip(queries, model.nearest(queries)):
        q = np.zeros(40)
        q[terms] = weight
        assert np.allclose(np.sort(dense @ q)[::-1][: len(sims)], sims) and np.allclose(dense[at] @ q, sims)


def test_every_term_that_passes_is_kept(spark):
    """300 toxic words make 1,200 terms; each of them alone finds toxic examples."""
    bad = ["".join(chr(97 + k // 26**i % 26) for i in (0, 1, 2)) + "zqxv" for k in range(300)]
    docs = [(2 * k, " ".join(bad[(30 * k + j) % 300] for j in range(60)) + f" plain{k}") for k in range(200)]
    docs += [(2 * k + 1, f"plain{k} words of no harm") for k in range(200)]
    docs += [(10_000 + k, w) for k, w in enumerate(bad)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs if i < 10_000], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    assert {b"=" + w.encode() for w in bad} <= set(model.terms) and len(model.terms) >= 1_200
    got = {r.id: r for r in toxicity.score_documents(frame, model).collect()}
    assert all(got[10_000 + k].evidence and got[10_000 + k].score >= 0.5 for k in range(300))


def test_toxicity_of_tricky_and_empty_tables(tricky, empty, rows, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 0), (8, None), (None, 1), (99, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(tricky, toxicity.fit(tricky, labels)).collect()
    assert Counter(r.id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score_documents(empty, none).collect() == [] and toxicity.keep_below(empty, none, 0.3).collect() == []
    assert toxicity.keep_below(tricky, none, 0.3).count() == len(rows)


def test_decontamination_against_brute_force(spark, tricky, empty, small):
    items = [(1, "What does the tale of the seven rivers tell? It tells of a long road home."), (2, None), (3, ""), (1, "What does the tale of the seven rivers tell? It tells of a long road home."), (4, "One single sentence about many odd things without an end")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"fill{k}" for k in range(90))
    docs = [
        (1, f"{filler} WHAT DOES the tale of the seven rivers tell?  It tells of a long road home. {filler}", True),
        (2, f"{filler} What does the tale of the seven rivers tell? {filler} nothing else", False),
        (3, f"{filler} one single sentence about many odd things without an end", True), (4, filler, False), (5, None, False), (6, "", False),
        (7, f"{filler} It tells of a long road home.", False),
    ]
    rows = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    for chars in (1 << 20, 40):  # one index, several
        got = decontaminate.contaminated(rows, frame, index_chars=chars).collect()
        assert sorted((r.id, r.item_id) for r in got) == [(1, 1), (3, 4)]
        assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 and r.score >= 0.5 for r in got)
        assert sorted(r.doc_id for r in decontaminate.keep_clean(rows, frame, index_chars=chars).collect()) == [2, 4, 5, 6, 7]
    assert decontaminate.contaminated(rows, frame.limit(0)).collect() == [] and decontaminate.contaminated(empty, frame).collect() == []
    assert decontaminate.keep_clean(tricky, frame).count() == tricky.count()


def test_decontamination_finds_every_planted_item(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, decontaminate.fold(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, *decontaminate.question_and_answer(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for d, tokens in docs:
        held = decontaminate.shingles(tokens)
        for i, q, a in items:
            if all(decontaminate.share_of(decontaminate.shingles(x), min(5, len(x)), tokens, held) >= 0.8 for x in (q, a)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op5_benchmark_bm25"](spark, sf).collect()}
    assert got == want and want


def test_mixing_repeats_and_reaches_the_weights(spark, tricky, empty):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'ten chars.' AS text", "IF(id % 10 < 8, 'a', 'b') AS source")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0)], "source string, weight double")
    got = mixing.poisson_replicate(docs, weights).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["a"] - 5000) < 300 and abs(n["b"] - 15_000) < 600
    big = mixing.poisson_replicate(docs.limit(300), weights, total_units=300 * 10 * 100.0).groupBy("doc_id").count()
    counts = [r["count"] for r in big.collect()]
    assert len(counts) == 300 and abs(np.mean(counts) - 100) < 12  # means above one part are sums of parts
    assert mixing.poisson_replicate(empty).collect() == []
    out = mixing.poisson_replicate(tricky)
    assert out.columns == tricky.columns + ["copy"]
    with pytest.raises(ValueError):
        mixing.poisson_replicate(tricky, copy_col="score")


def test_mixing_order_is_not_the_input_order(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    ids = [r.doc_id for r in mixing.poisson_replicate(docs).collect()]
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.1


PAGES = [
    (1, "http://a/\r\nX: y", "p" * 1200), (2, None, "p" * 1200), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
    (7, "u", "WARC/1.1\r\n\r\n" * 200), (2, "again", "p" * 1200), (None, "u", "p" * 1200), (8, "ü", "é" * 700 + "\r\n\r\n"), (9, "u", "q" * 500_000),
]


def test_archives_of_tricky_pages(spark):
    import hashlib

    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, keeper long")
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.archive_roundtrip(frame).collect())
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        ids = [j for j, _, x in PAGES if (x or "").encode() == raw and j is not None]
        revisit = len(raw) >= 1000 and ids and i != max(ids)
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None)] += 1
    assert got == want
    assert warc.archive_roundtrip(frame.limit(0)).collect() == []


def test_every_member_stands_alone(spark):
    import gzip
    import json

    frame = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string")
    plain = warc.write_archives(warc.decide(frame, id_col="page_id", payload_col="html", url_col="url"))
    for r in warc.normalise(plain).collect():
        raw = open(r.path.removeprefix("file:"), "rb").read()
        for line in open(r.index_path.removeprefix("file:")):
            e = json.loads(line)
            assert gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")


ORACLES = [n for n in entry.oracle_sql() if n.startswith("op")]


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name, small):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    place = [list(rel.columns).index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[k] for k in place) for r in rel.fetchall())


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        counts.append(out.count())
        if name != "token_files":
            assert out.columns == columns
            docs = out.cache()
    assert counts[-1] == counts[-2] and counts[0] > 0.8 * 200
    rows = corpus_pipeline.run(spark, small).orderBy("start").collect()
    assert len(rows) == counts[-1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:])) and rows[0].start == 0


def test_stages_of_an_empty_and_a_tricky_table(spark, tricky, empty, small):
    import corpus_pipeline

    for docs in (empty, tricky):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
            assert docs.count() >= 0


def test_base_text_is_near_its_copy():
    a, b = (simhash.simhash(shingle_hashes(words(t.encode()), 5)) for t in (BASE, BASE + " end"))
    assert (a ^ b).bit_count() <= 8


def test_columns_named_like_those_used_inside_come_back_unchanged(spark):
    names = ["mix_row", "mix_n", "mix_copy", "mix_place", "mix_pieces", "mix_cdf", "mix_source", "units", "rate", "w"]
    names += ["dedup_row", "dedup_null", "dedup_id", "dedup_th", "dedup_n", "node", "label", "a.b"]
    rows = [(k, f"text number {k} of its own kind " * 3, f"s{k % 2}", *[f"{n} {k}" for n in names]) for k in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    want = {r[0]: r for r in rows}
    mixed = mixing.poisson_replicate(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    assert mixed.count() > 10 and all(tuple(r)[:-1] == want[r.doc_id] for r in mixed.collect())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and all(tuple(r) == want[r.doc_id] for r in kept.collect()) and kept.count() > 0
    with pytest.raises(ValueError):
        mixing.poisson_replicate(docs, copy_col="DOC_ID")


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_search_finds_every_passage_and_item_at_the_threshold(threshold):
    """All passages against all items by plain BM25, with rare, common and repeated words and a last short segment."""
    rng = np.random.default_rng(11)
    common = [f"c{k}" for k in range(12)]
    items = []
    for k in range(90):
        n = int(rng.integers(1, 40))
        items.append((k, " ".join(rng.choice(common) if rng.random() < 0.5 else f"r{rng.integers(0, 160)}" for _ in range(n))))
    folded = [decontaminate.fold(t) for _, t in items]
    df = Counter(w for f in folded for w in set(f))
    mean = sum(map(len, folded)) / len(folded)
    index = decontaminate.Index(items, df, len(items), mean)

    def weights(tokens):
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(tokens) / mean)
        return {w: np.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * f * (decontaminate.K1 + 1) / (f + norm) for w, f in Counter(tokens).items()}

    found = 0
    for size in (0, 1, 30, index.length, 3 * index.length + 5, 900):
        tokens = []
        while len(tokens) < size:
            part = folded[int(rng.integers(0, len(folded)))]
            tokens += part[: int(rng.integers(0, len(part) + 1))] if rng.random() < 0.6 else [b"other", f"r{rng.integers(0, 160)}".encode()]
        tokens, step = tokens[:size], index.length
        segments = -(-len(tokens) // step)
        want = {}
        for p in range(max(1, segments - 1)):
            lo, hi = p * step, min(len(tokens), (p + 2) * step)
            held = set(tokens[lo:hi])
            for (ident, _), f in zip(items, folded):
                w = weights(f)
                score = sum(x for t, x in w.items() if t in held) / sum(w.values())
                if score >= threshold:
                    want[ident, lo, hi] = round(score, 9)
        got = {(index.ids[k], lo, hi): round(x, 9) for k, lo, hi, x in index.search(tokens, threshold)}
        assert got == want
        found += len(want)
    assert found > 20
    with pytest.raises(ValueError):
        list(index.search(tokens, 0.2))
