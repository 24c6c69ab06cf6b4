"""Secret scan with column expressions only: fixed patterns, and Markov models of characters.

Fixed patterns give spans of the kinds ``assign``, ``access`` and ``hex``.  The
kind ``markov`` is added by two first-order Markov models over characters, one
trained on random strings, one on ordinary identifiers.  Long runs of their
alphabet are cut at spans of the other kinds.  In each piece the stretches with
the largest sums of log-likelihood ratios are found: a stretch begins where the
sum is lowest, and ends at its largest sum when the sum falls ``DROP`` below it
or to zero, so words beside a key take nothing from it.  A stretch whose sum is
above the thresholds is a secret, with the letters and digits that adjoin it,
if these are at least ``LEAST_LENGTH`` characters and not digits only.

Positions come from the text between matches: a match starts after all pieces
and matches before it.  Everything of a document stays in its row, so nothing
is shuffled; patterns run only on texts that a cheap test lets through, and the
tests let every text with a match through.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import save

# The patterns, as stated for every implementation.
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"  # the same matches as AKIA[A-Z0-9]+ of 16 or more characters
HEX = "[0-9a-f]{32,}"  # the same matches as [0-9a-f]+ of 32 or more characters
LEAST_LENGTH = 16
TOKEN = f"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}"
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET)
RANDOM_STRINGS = 3_000
SAMPLE_DOCS = 300
LEAST_RATIO = 10.0  # natural logarithm: one false token in some 20,000 at even odds
LEAST_MEAN = 0.7  # per transition, so that long ordinary tokens don't add up small gains
DROP = 10.0  # a stretch is closed when its sum has fallen by this much
BACKED = 0.2  # share of the character class's estimate in a transition's
CLASSES = ((0, 26), (26, 52), (52, 62), (62, SIZE))  # upper and lower case letters, digits, signs
KINDS = ("assign", "access", "hex", "markov")


def labelled_strings(docs: DataFrame, *, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows (token, random): the labelled sample both models learn from.

    Random: ``RANDOM_STRINGS`` digests written in base 64, in upper and lower
    case letters with digits, and in hexadecimal.  Ordinary: the words of a
    bounded sample of whole documents (the smallest hashes of the id; of a
    repeated id the smallest text, none without an id), joined the ways
    identifiers and paths join them.
    """
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    plain = F.translate(packed, "=\r\n", "")
    random = docs.sparkSession.range(RANDOM_STRINGS).select(
        F.explode(F.array(
            plain, F.translate(plain, "+/", "-_"), F.regexp_replace(plain, "[+/]", ""),
            F.upper(F.regexp_replace(plain, "[+/]", "")), F.lower(F.regexp_replace(plain, "[+/]", "")), digest,
        )).alias("token"),
        F.lit(True).alias("random"),
    )
    words = F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda w: F.length(w).between(2, 19))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    ids = save(texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs), "secret-sample-ids")
    # At most sample_docs ids: a bounded broadcast.  Only their texts leave their tasks.
    picked = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).select(words.alias("w"))
    ordinary = picked.select(
        F.explode(F.array(
            F.array_join("w", "_"), F.array_join("w", "-"), F.array_join("w", "/"), F.upper(F.array_join("w", "_")),
            F.array_join(F.transform("w", lambda w: F.initcap(w)), ""),
        )).alias("token"),
        F.lit(False).alias("random"),
    )
    return random.unionAll(ordinary)


def log_ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, row by row of the alphabet; SIZE * SIZE numbers."""
    # Two passes of pairs, from the first and from the second character, give every transition.
    chars = samples.where(F.length("token") > 1).select(
        "random",
        F.concat(
            F.regexp_extract_all("token", F.lit(".."), F.lit(0)),
            F.regexp_extract_all(F.substr("token", F.lit(2)), F.lit(".."), F.lit(0)),
        ).alias("two"),
    )
    counts = (
        chars.select("random", F.explode("two").alias("two")).groupBy("random", "two").agg(F.count("*").alias("n"))
        .select("random", (F.instr(F.lit(ALPHABET), F.substring("two", 1, 1)) - 1).alias("a"),
                (F.instr(F.lit(ALPHABET), F.substring("two", 2, 1)) - 1).alias("b"), "n")
        .where("a >= 0 AND b >= 0").collect()
    )
    table = {True: [0] * (SIZE * SIZE), False: [0] * (SIZE * SIZE)}
    for r in counts:
        table[r["random"]][r["a"] * SIZE + r["b"]] += r["n"]
    random, ordinary = transitions(table[True]), transitions(table[False])
    return [log(p) - log(q) for p, q in zip(random, ordinary)]


def transitions(counts: list[int]) -> list[float]:
    """Probability of each transition: its share, mixed with that of a character of its class after the first's class.

    So a transition that no sample holds between two letters stays far likelier
    than one from a letter to a digit, and long compound words stay ordinary.
    """
    out = [0.0] * (SIZE * SIZE)
    for lo, hi in CLASSES:
        to = [sum(counts[a * SIZE + b] for a in range(lo, hi) for b in range(*c)) for c in CLASSES]
        back = [0.0] * SIZE
        for (first, end), n in zip(CLASSES, to):
            for b in range(first, end):
                back[b] = (n + 0.5) / (sum(to) + 0.5 * len(CLASSES)) / (end - first)
        for a in range(lo, hi):
            row = counts[a * SIZE : (a + 1) * SIZE]
            total = sum(row)
            backed = BACKED if total else 1.0
            out[a * SIZE : (a + 1) * SIZE] = [
                (1 - backed) * n / max(total, 1) + backed * p for n, p in zip(row, back)
            ]
    return out


EMPTY = "cast(array() as array<struct<s:int,e:int,v:int>>)"


def _spans(gaps: str) -> Column:
    """Starts and ends from the gap before and the length of each match.

    ``gaps`` is a column of structs (gap, len, v).  Matches are walked in blocks
    of 256, so lists stay short while they grow.
    """
    step = (
        "(a, x) -> named_struct('pos', a.pos + x.gap + x.len, 'part', array_append(a.part, "
        "named_struct('s', a.pos + x.gap, 'e', a.pos + x.gap + x.len, 'v', x.v)))"
    )
    return F.expr(f"""
        CASE WHEN size({gaps}) > 0 THEN flatten(aggregate(
          sequence(0, (size({gaps}) - 1) div 256),
          named_struct('pos', 0, 'all', cast(array() as array<array<struct<s:int,e:int,v:int>>>)),
          (acc, b) -> aggregate(slice({gaps}, cast(b * 256 + 1 as int), 256), named_struct('pos', acc.pos, 'part', {EMPTY}), {step},
            r -> named_struct('pos', r.pos, 'all', array_append(acc.all, r.part))),
          acc -> acc.all)) ELSE {EMPTY} END
    """)


def _with_spans(df: DataFrame, text: str, name: str, pattern: str, test: Column, value_group: int | None = None) -> DataFrame:
    """Adds the array ``name`` of (s, e, v): start, end and length of the value, in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumn("x_m", F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    found = F.size("x_m") > 0
    df = df.withColumn("x_p", F.when(found, F.split(text, pattern)).otherwise(none))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else F.col("x_m")
    df = df.withColumn("x_v", F.when(found, value).otherwise(none))
    # Arrays stay outside lambdas, where the optimizer could have them split anew for each element.
    pairs = F.zip_with(
        F.slice("x_p", F.lit(1), F.size("x_m")), "x_m",
        lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("len")),
    )
    whole = F.zip_with(
        pairs, "x_v", lambda q, v: F.struct(q["gap"].alias("gap"), q["len"].alias("len"), F.char_length(v).alias("v"))
    )
    df = df.withColumn("x_z", F.when(found, whole).otherwise(F.expr("cast(array() as array<struct<gap:int,len:int,v:int>>)")))
    return df.withColumn(name, _spans("x_z")).drop("x_m", "x_p", "x_v", "x_z")


def _tag(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _of(k: int):
    return lambda x: x["k"] == k


def _let(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _cut(x: Column, fixed: Column) -> Column:
    """The pieces of a span outside the fixed spans."""
    whole = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
    touching = F.filter(fixed, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))

    def without(pieces: Column, y: Column) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.array(
            F.struct(p["s"].alias("s"), F.least(p["e"], F.greatest(y["s"], p["s"])).alias("e")),
            F.struct(F.greatest(p["s"], F.least(y["e"], p["e"])).alias("s"), p["e"].alias("e")),
        )))

    return F.filter(
        F.when(F.size(touching) > 0, F.aggregate(touching, whole, lambda acc, y: F.filter(
            F.array_distinct(without(acc, y)), lambda p: p["e"] - p["s"] >= LEAST_LENGTH
        ))).otherwise(whole),
        lambda p: p["e"] - p["s"] >= LEAST_LENGTH,
    )


STRETCHES = "array<struct<b:int,e:int,sum:double>>"


def _stretches(piece: Column, table: Column) -> Column:
    """(b, e, sum) of the stretches of a string: first and last character, sum of the ratios between them."""
    alphabet = F.lit(ALPHABET)
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(alphabet, c) - 1)

    def state(a, i, b, total, best, e, out) -> Column:
        return F.struct(
            a.alias("a"), i.alias("i"), b.alias("b"), total.alias("sum"), best.alias("best"), e.alias("e"), out.alias("out")
        )

    def closed(acc: Column) -> Column:
        stretch = F.struct(acc["b"].alias("b"), acc["e"].alias("e"), acc["best"].alias("sum"))
        return F.when(acc["best"] > 0, F.array_append(acc["out"], stretch)).otherwise(acc["out"])

    def add(acc: Column, c: Column) -> Column:
        known = (acc["a"] >= 0) & (c >= 0)
        total = acc["sum"] + F.when(known, F.get(table, acc["a"] * SIZE + c)).otherwise(0.0)
        i, zero = acc["i"] + 1, F.lit(0.0)
        return _let(total, lambda t: F.when(
            (t <= 0) | (acc["best"] - t > DROP), state(c, i, i, zero, zero, i, closed(acc))
        ).otherwise(state(
            c, i, acc["b"], t, F.greatest(acc["best"], t), F.when(t >= acc["best"], i).otherwise(acc["e"]), acc["out"]
        )))

    start = state(
        F.lit(-1), F.lit(-1), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.expr(f"cast(array() as {STRETCHES})")
    )
    return F.aggregate(codes, start, add, closed)


def _secrets_in(piece: Column, at: Column, table: Column, least_ratio: float, least_mean: float) -> Column:
    """Spans (s, e) of the secrets in a string that begins at ``at``; spans that overlap are one."""
    good = F.filter(
        _stretches(piece, table),
        lambda x: x["sum"] >= F.greatest(F.lit(least_ratio), (x["e"] - x["b"]) * F.lit(least_mean)),
    )

    def whole(x: Column) -> Column:  # without signs at its ends, with the letters and digits beside it
        core = F.substring(piece, x["b"] + 1, x["e"] - x["b"] + 1)
        s = x["b"] + F.char_length(F.regexp_extract(core, "^[+/_-]*", 0))
        e = x["e"] + 1 - F.char_length(F.regexp_extract(F.reverse(core), "^[+/_-]*", 0))
        return _let(F.struct(s.alias("s"), e.alias("e")), lambda y: F.struct(
            (y["s"] - F.char_length(F.regexp_extract(F.reverse(F.substring(piece, F.lit(1), y["s"])), "^[A-Za-z0-9]*", 0))).alias("s"),
            (y["e"] + F.char_length(F.regexp_extract(F.substr(piece, y["e"] + 1), "^[A-Za-z0-9]*", 0))).alias("e"),
        ))

    def joined(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when((F.size(out) > 0) & (F.coalesce(F.get(out, F.size(out) - 1)["e"], F.lit(-1)) > x["s"]), F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))
        )).otherwise(F.array_append(out, x))

    spans = F.aggregate(F.transform(good, whole), F.expr("cast(array() as array<struct<s:int,e:int>>)"), joined)
    kept = F.filter(spans, lambda x: (x["e"] - x["s"] >= LEAST_LENGTH) & F.substring(
        piece, x["s"] + 1, x["e"] - x["s"]).rlike("[A-Za-z]"))
    return F.transform(kept, lambda x: F.struct((at + x["s"]).alias("s"), (at + x["e"]).alias("e")))


def scan_secrets(
    docs: DataFrame, ratios: list[float] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    least_ratio: float = LEAST_RATIO, least_mean: float = LEAST_MEAN,
) -> DataFrame:
    """Rows (id, spans): spans is an array of (s, k, e), start, place of the kind in KINDS, end, sorted.

    One row per input row.  Null and empty texts have no span; null ids and
    repeated rows are kept; other columns are ignored; an empty table gives an
    empty one (the ordinary model then has no sample and is even).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ratios is None:
        ratios = log_ratios(save(labelled_strings(rows, id_col="id", text_col="text"), "secret-samples"))
    lowered = F.lower("text")
    keyword = F.lit(False)
    for word in KEYWORDS:
        keyword = keyword | lowered.contains(word)
    rows = rows.withColumn("keyword", keyword).withColumn("long", F.col("text").rlike(TOKEN.replace(",}", "}")))
    rows = _with_spans(rows, "text", "assign", ASSIGN, F.col("keyword"), 2)
    rows = rows.withColumn("assign", F.filter("assign", lambda x: x["v"] >= LEAST_VALUE))
    rows = _with_spans(rows, "text", "access", ACCESS, F.col("text").contains("AKIA"))
    rows = _with_spans(rows, "text", "hex", HEX, F.col("long"))
    rows = _with_spans(rows, "text", "token", TOKEN, F.col("long"))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a constant
    rows = rows.withColumn("fixed", F.concat("assign", "access", "hex"))
    pieces = F.flatten(F.transform("token", lambda x: _cut(x, F.col("fixed"))))
    rows = rows.withColumn(
        "piece", F.when(F.size("token") > 0, pieces).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))
    )
    found = F.flatten(F.transform("piece", lambda p: _let(
        F.substring(F.col("text"), p["s"] + 1, p["e"] - p["s"]),
        lambda piece: _secrets_in(piece, p["s"], table, least_ratio, least_mean),
    )))
    rows = rows.withColumn("markov", F.when(F.size("piece") > 0, found).otherwise(F.col("piece")))
    tagged = [F.transform(kind, _tag(k)) for k, kind in enumerate(KINDS)]
    return rows.select("id", F.array_sort(F.concat(*tagged)).alias("spans"))


def spans_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of the given kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    wanted = F.filter(spans, lambda x: x["k"] < len(kinds))
    return F.array_join(
        F.transform(wanted, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts by kind, hash of the base spans, all spans."""
    rows = scan_secrets(docs, **options)
    counts = [F.size(F.filter("spans", _of(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select(
        "id", *counts, F.sha2(spans_text(F.col("spans"), KINDS[:3]), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
