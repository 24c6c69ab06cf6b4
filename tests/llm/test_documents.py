"""Operators on single documents against brute force, on tricky and on empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import fingerprints, language_model, licenses, secrets, tokens
from seriesloom.llm.queries import tokenizer_path
from seriesloom.llm.text import words


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def test_fingerprints_of_tricky_rows(tricky, rows):
    got = Counter(tuple(r) for r in fingerprints.fingerprint_documents(tricky).collect())
    want = Counter()
    order = ordered(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        new = t[: len(t) - cut] + nxt[:cut]
        a, b, c = (fingerprints.sketch(words(x.encode())) for x in (t, new, nxt))
        want[(
            i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.to_text(a), fingerprints.to_text(b),
            fingerprints.likeness(a, b), fingerprints.likeness(a, c), fingerprints.containment(a, c),
        )] += 1
    assert got == want


def test_sketch_merges_and_estimates():
    a = [f"w{k}".encode() for k in range(4000)]
    b = a[:3000] + [f"v{k}".encode() for k in range(9000)]
    sa, sb = fingerprints.sketch(a), fingerprints.sketch(b)
    assert abs(fingerprints.containment(sa, sb) - 0.75) < 0.08
    short = fingerprints.sketch([b"a", b"b"])
    assert len(short) == 1 and fingerprints.from_text(fingerprints.to_text(short)).tolist() == short.tolist()
    from seriesloom.llm.text import shingle_hashes
    union = np.concatenate([shingle_hashes(a, 5), shingle_hashes([b"a", b"b"], 5)])
    assert fingerprints.merge(sa, short).tolist() == fingerprints._keep(union, fingerprints.SCALE).tolist()


def test_token_files_of_tricky_rows(tricky, rows, spark):
    from tokenizers import Tokenizer

    files = tokens.write_token_files(tricky, tokenizer_path())
    got = sorted((tuple(r) for r in tokens.read_token_files(files, with_ids=True).collect()), key=lambda r: r[1])
    library, at = Tokenizer.from_file(tokenizer_path()), 0
    for (i, t), row in zip(ordered(rows), got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert row == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids)
        at += len(ids)


def test_token_file_reads_only_wanted_frames_and_checks_them(tmp_path):
    path = tmp_path / "x.tokens"
    with open(path, "wb") as out:
        writer = tokens.FileWriter(out)
        for k in range(10):
            writer.add(k, np.full(30_000, k, "<u4").tobytes())
        writer.close()
    raw = bytearray(path.read_bytes())
    with open(path, "rb") as file:
        reader = tokens.FileReader(file, len(raw))
        opened = []
        inner = reader.frame
        reader.frame = lambda k: opened.append(k) or inner(k)
        (found,) = reader.documents({7})
        assert found[0] == 7 and found[1] == 210_000 and set(np.frombuffer(found[2], "<u4")) == {7}
        assert len(set(opened)) == 1 and len(reader.frames) > 2
    import zstandard

    whole = b"".join(np.full(30_000, k, "<u4").tobytes() for k in range(10))
    with open(path, "rb") as file:  # an ordinary reader skips the tables
        assert zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read() == whole
    entry = tokens.ENTRY.size
    at = len(raw) - tokens.FOOTER.size - entry  # the last frame's entry
    raw[at + 8] ^= 1
    path.write_bytes(raw)
    with open(path, "rb") as file, pytest.raises(ValueError, match="checksum"):
        list(tokens.FileReader(file, len(raw)).documents())


def test_licenses_of_tricky_rows(tricky, rows):
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan_licenses(tricky).collect())
    want = Counter()
    for i, t in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        places = [(k, lab) for p, lab in licenses.BASE for k in range(len(w)) if b" ".join(w[k : k + len(p.split())]) == p.encode()]
        base = sorted({lab for _, lab in places})
        starts = [k for k, _ in places]
        want[(i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(base))] += 1
    assert got == want


def ready(counts=None):
    templates = licenses.ready_templates(licenses.TEMPLATES, counts or {}, licenses.THRESHOLD)
    by_word: dict = {}
    for t in templates:
        for w in t.prefix:
            by_word.setdefault(w, []).append(t.number)
    return templates, by_word


def test_every_block_at_the_threshold_is_found():
    """All templates, edited to the threshold and around it, at every offset, against every block there is."""
    rng = np.random.default_rng(3)
    for k, (_, text, _) in enumerate(licenses.TEMPLATES):
        words_ = licenses.alnum_words(text.encode())
        kinds = sorted(set(words_))
        templates, by_word = ready({w: int(rng.integers(0, 50)) for w in kinds})
        t = templates[k]
        for offset in range(2 * len(words_) + 2):
            drop = set(rng.choice(len(kinds), t.n - t.need + int(rng.integers(-1, 2)), replace=False).tolist()) if t.n > t.need + 1 else set()
            kept = []
            for w in words_:
                kept += [w] if kinds.index(w) not in drop else [b"other"] if rng.random() < 0.5 else []
            tokens_ = [f"n{j}".encode() for j in range(offset)] + kept + [b"z"] * 70
            found = [p for p in licenses.template_places(tokens_, templates, by_word) if p.template is t]
            blocks = [set(tokens_[b : b + t.width]) for b in range(len(tokens_))]
            best = max(len(t.words & b) for b in blocks)
            assert best == t.n - len(drop) and bool(found) == (best >= t.need)
            if found:
                assert max(p.matched for p in found) == best
                assert all(offset <= p.first <= p.last < offset + len(kept) for p in found)


def test_sliding_finds_what_all_blocks_find():
    """Random runs of template words: a word lies in a place exactly if some block cut to the template's words covers it."""
    rng = np.random.default_rng(5)
    t = licenses.Template(0, "x", "a b a c d e", {}, 0.8)
    for _ in range(300):
        tokens_ = [bytes([97 + int(c)]) for c in rng.integers(0, 9, int(rng.integers(0, 60)))]
        got = licenses.template_places(tokens_, [t], {w: [0] for w in t.prefix})
        best = max((len(t.words & set(tokens_[b : b + t.width])) for b in range(len(tokens_))), default=0)
        assert max((p.matched for p in got), default=0) == (best if best >= t.need else 0)
        for p in got:
            assert len(t.words & set(tokens_[p.core[0] : p.core[1] + 1])) == p.matched
        inside = {j for p in got for j in range(p.first, p.last + 1)}
        for b in range(len(tokens_)):
            block = [j for j in range(b, min(len(tokens_), b + t.width)) if tokens_[j] in t.words]
            if len({tokens_[j] for j in block}) >= t.need:
                assert inside & set(block)


@pytest.mark.parametrize("text, labels", [
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("released under the BSD License", "bsd"),
    ("Released under the Apache License.", "apache"),
    ("Licensed under the Mozilla Public License, version 2.0", "mpl"),
    (licenses.TEMPLATES[5][1], "gpl"),
    (licenses.TEMPLATES[6][1].replace("General Public License", "GPL"), "lgpl"),
    ("The film was released under the new license last year", ""),
    ("Released under the MIT License. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc,mit"),
])
def test_similar_notices_are_told_apart(spark, text, labels):
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.labels == labels and (row.score > 0) == bool(labels)


def test_secrets_of_tricky_rows(tricky, rows):
    even = [0.0] * (secrets.SIZE**2)
    got = Counter((r.id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_digest(tricky, ratios=even).collect())
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    want = Counter()
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))
        n = Counter(k for _, k, _ in spans)
        want[(i, n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want


def test_markov_models_tell_random_from_ordinary(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ratios = secrets.log_ratios(secrets.labelled_strings(docs, id_col="doc_id", text_col="text"))
    texts = ["x Zx81kQpL0vRt5YwN3mJ7uB2cQ9 y", "x theonthe_anderen_thation_hering_ation y", "x this/is/an/ordinary/path/of/words y", "short Zx81kQ"]
    got = secrets.secret_digest(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), ratios=ratios)
    assert {r.id: r.n_markov for r in got.collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    assert next(r.spans for r in got.collect() if r.id == 0) == "markov:2:28"


@pytest.fixture(scope="module")
def learned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return secrets.log_ratios(secrets.labelled_strings(docs, id_col="doc_id", text_col="text"))


def markov_spans(spark, texts, ratios):
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).collect()
    return {r.id: [(x.s, x.e) for x in r.spans if x.k == 3] for r in rows}


def test_keys_in_paths_are_found_and_long_words_are_not(spark, learned):
    rng = np.random.default_rng(11)
    letters = np.array(list(secrets.ALPHABET[:62]))
    texts, keys = [], []
    for k in range(200):
        key = "".join(rng.choice(letters, int(rng.integers(18, 40))))
        path = ["at ", "see /this/are/of/them/and/others/", "export_the_station_", "the-nation-of-"][k % 4]
        texts.append(path + key + ["", "/with/that/another/this", " y", "_and_there_is_more"][k // 4 % 4])
        keys.append((len(path), len(path) + len(key)))
    got = markov_spans(spark, texts, learned)
    assert sum(any(s < z and a < e and min(e, z) - max(s, a) >= 0.9 * (z - a) for s, e in got[k]) for k, (a, z) in enumerate(keys)) >= 180
    words_ = [
        "Donaudampfschifffahrtsgesellschaftskapitaen", "Rindfleischetikettierungsueberwachungsaufgabe", "internationalization",
        "nichtsdestoweniger/gegenueberstellung", "the_quick_station_of_the_nation", "counterrevolutionaries", "4475383770160990",
    ]
    assert not any(markov_spans(spark, words_, learned).values())


def test_parts_outside_fixed_spans_are_scored(spark, learned):
    hexed, key = "0123456789abcdef" * 2, "Zx81kQpL0vRt5YwN3mJ7uB2cQ9"
    text = f"x {hexed}/{key} and {key}/{hexed}/{key}"
    (spans,) = markov_spans(spark, [text], learned).values()
    starts = [m.start() for m in re.finditer(key, text)]
    assert [(s, e) for s, e in spans] == [(k, k + len(key)) for k in starts]


def test_stretches_are_those_of_a_plain_walk(spark):
    """The fold against the same rule written as a loop, on random strings and random ratios."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    ratios = rng.normal(0, 3, secrets.SIZE**2).round(2).tolist()
    texts = ["".join(rng.choice(list(secrets.ALPHABET), int(rng.integers(1, 120)))) for _ in range(60)]
    table = F.lit(ratios)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: [(x.b, x.e, round(x.sum, 6)) for x in r.x] for r in rows.select("k", secrets._stretches(F.col("t"), table).alias("x")).collect()}
    for k, t in enumerate(texts):
        codes, want = [secrets.ALPHABET.index(c) for c in t], []
        total = best = 0.0
        b = e = 0
        for i in range(1, len(codes)):
            total += ratios[codes[i - 1] * secrets.SIZE + codes[i]]
            if total <= 0 or best - total > secrets.DROP:
                want += [(b, e, round(best, 6))] if best > 0 else []
                total, best, b, e = 0.0, 0.0, i, i
            elif total >= best:
                best, e = total, i
        assert got[k] == want + ([(b, e, round(best, 6))] if best > 0 else [])


def test_language_model_of_tricky_rows(tricky, rows):
    got = Counter()
    scores = {}
    for r in language_model.score_documents(tricky).collect():
        got[(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))] += 1
        scores[r.id, r.n_tokens] = r.score
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", lowered(t)) + ["end"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c = Counter(w for _, ws, held in docs if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, ws, held in docs:
        base = sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws)
        want[(i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6))] += 1
    assert got == want
    assert all(math.isfinite(s) and s < 0 for s in scores.values())


def test_language_model_scores_equal_brute_force(tricky, rows, spark):
    """Counts, histogram and mixture anew with dictionaries; the sums over all words are one in every context."""
    docs = [(i, [None, *re.findall(rb"[^\x20\x09-\x0D]+", lowered(t)), "end"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    one = Counter(w for _, ws, held in docs if not held for w in ws[1:])
    two = Counter(p for _, ws, held in docs if not held for p in zip(ws, ws[1:]))
    starts = sum(not held for *_, held in docs)
    n, uniform = sum(one.values()), 1 / (len(one) + 1)

    def estimates(a, b, out):
        context = (starts if a is None else one[a]) - out
        bucket = min(math.frexp(max(context, 0))[1], language_model.CONTEXTS - 1)
        return (two[a, b] - out) / context if context > 0 else 0.0, (one[b] - out) / max(1, n - out), bucket

    def bin_of(p):
        return min(max(math.floor(-math.log10(p) * language_model.GRID), 0), language_model.DECADES * language_model.GRID - 1) if p > 0 else -1

    cells = Counter()
    for _, ws, held in docs:
        if not held:
            for a, b in zip(ws, ws[1:]):
                p2, p1, bucket = estimates(a, b, 1)
                cells[bucket, bin_of(p2), bin_of(p1)] += 1
    weights = language_model.learn_weights([(*k, c) for k, c in cells.items()], uniform)

    def probability(a, b):
        p2, p1, bucket = estimates(a, b, 0)
        return weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] * uniform

    want = Counter((i, len(ws) - 1, round(sum(math.log10(probability(a, b)) for a, b in zip(ws, ws[1:])), 6)) for i, ws, _ in docs)
    for partitions in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = Counter((r.id, r.n_tokens, round(r.score, 6)) for r in language_model.score_documents(tricky).collect())
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for context in (None, b"alpha", b"a", b"words"):
        seen = sum(probability(context, w) for w in one)
        assert math.isclose(seen + probability(context, "a word that is nowhere"), 1.0, rel_tol=1e-9)


def test_language_model_beats_the_base(spark, small):
    rows = language_model.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
    weights = language_model.learn_weights([(3, 5, 20, 40), (3, -1, 10, 60), (0, -1, 30, 5)], 1e-4)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[3, 1] > 0


def test_packing_round_trips():
    for values in ([], [0], [255, 256, 2**64 - 1], list(range(0, 10**6, 997))):
        v = np.array(values, np.uint64)
        assert language_model.unpack(language_model.pack(v)).tolist() == values
        assert language_model.unpack_sorted(language_model.pack_sorted(v)).tolist() == values


@pytest.mark.parametrize("run", [
    fingerprints.fingerprint_documents, licenses.scan_licenses, secrets.secret_digest, language_model.score_documents,
    lambda d: tokens.read_token_files(tokens.write_token_files(d, tokenizer_path())),
])
def test_empty_tables_give_empty_results(empty, run):
    assert run(empty).collect() == []


def test_encoder_equals_the_library_on_odd_spacing():
    import random

    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path())
    bits = ["foo", " ", "  ", "\n", "\t", ".", "é", "世界", " ", " ", "'s", "1", "<|endoftext|>", "\r", "\x1c", "🙂", "word,", "é.!", "the", "’", "ſ", "½"]
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
