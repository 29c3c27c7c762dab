"""Collocations, periodic runs and token counts against brute force, on the small tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from paperloom.llm import collocations, runs, token_counts

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, runs int, collapsed int, `a b` int, n long, phrase string, `group` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(8)
    some = [" ".join(rng.choice(["ab", "c", "Ab", "é", "x.", "y,", "\x1c", "▁", "a\x00b"]) for _ in range(rng.randrange(300))) for _ in range(40)]
    return [None, "", " \n\t", ".", "one", "a b a b a b a b", "a " * 5, "a " * 6, "x y z " * 4 + "x y", "big " + "red dog. " * 30, "<s> </s> <unk> <0x41>", "日本語 " * 900, "ab" * 20_000, " " * 1000, *some, *some[:5]]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], "s", "c", 1, 2, 3, 4, "p", "g") for k, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- token counts -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))


def test_counts_of_the_query(spark, library):
    got = {r["doc_id"]: r for r in token_counts.op13_token_counts(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        text, own = r["text"] or "", got[r["doc_id"]]
        n = len(library.encode(text))
        assert (own["n_bytes"], own["n_tokens"], own["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_counts_of_awkward_texts(odd, none, library):
    rows = token_counts.token_counts(odd).collect()
    assert sorted(rows[0].asDict()) == sorted(odd.columns)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((k, len(library.encode(t or ""))) for k, t in enumerate(odd_texts()))
    assert token_counts.token_counts(none).count() == 0


def test_counts_in_chunks_and_small_caches(library, monkeypatch):
    rng = random.Random(2)
    letters = "aabcdetheinerion   ▁\n\x00é日ß<s>0.,'𠀀한Ａ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(700))) for _ in range(300)] + ["a" * 3000, "the" * 500, "▁" * 33]
    want = [len(x) for x in library.encode(texts)]
    own = token_counts.compiled(public_tokenizers.path(token_counts.MODEL))
    for chunk, few, most in ((256, 8, 1 << 20), (5, 1, 1 << 20), (17, 8, 50)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "FEW", few)
        monkeypatch.setattr(token_counts, "TRANSITIONS", most)
        assert [int(x) for k in range(0, len(texts), 100) for x in own.counts(texts[k : k + 100])] == want


def test_transducer_of_small_vocabularies():
    rng = random.Random(6)
    for _ in range(60):
        names = list("ab▁") + ["".join(rng.choice("ab") for _ in range(rng.randint(2, 4))) for _ in range(6)] + ["▁a", "▁▁"]
        pieces = {p: -float(rng.randrange(9)) for p in names}
        own = token_counts.Transducer(pieces)
        texts = ["".join(rng.choice("aab b") for _ in range(rng.randrange(12))) for _ in range(60)]

        def merged(text):
            parts = list("▁" + text.replace(" ", "▁")) if text else []
            while best := min(((-pieces[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in pieces), default=None):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            return len(parts)

        assert own.counts(texts).tolist() == [merged(t) for t in texts]


# --- periodic runs ----------------------------------------------------------------------------------


def plain_runs(w, exponent=4, least=6):
    """All runs (start, period, length) by trying every period."""
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(w[i + r : i + size] == w[i : i + size - r] for r in range(1, q)):
                out.add((i, q, size))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_against_every_period():
    rng = random.Random(5)
    for _ in range(600):
        letters = rng.choice([1, 2, 3, 5, 30])
        w = [rng.randrange(letters) for _ in range(rng.randrange(50))]
        for _ in range(rng.randrange(3)):
            part, at = [rng.randrange(letters) for _ in range(rng.randint(1, 6))], rng.randint(0, len(w))
            w[at:at] = (part * 8)[: rng.randrange(1, 40)]
        for exponent, least in ((4, 6), (3, 4)):
            want = plain_runs(w, exponent, least)
            assert runs.lyndon_runs(w, exponent, least) == want
            _, _, found = runs.texts_runs(pa.array([" ".join(f"w{x}" for x in w), None, ""]), exponent, least)
            assert found.get(0, []) == want and not {1, 2} & found.keys()


def test_runs_without_hashes(monkeypatch):
    """Colliding hashes are noticed, and words alone decide."""
    w = [1, 2] * 9 + [3] + [4, 5, 4] * 6
    want = plain_runs(w)
    monkeypatch.setattr(runs, "_PRIME", 1)
    assert runs.lyndon_runs(w) == want


def test_long_runs():
    assert runs.lyndon_runs([7] * 5000) == [(0, 1, 5000)]
    assert runs.lyndon_runs([1, 2] * 2500) == [(0, 2, 5000)]
    assert runs.lyndon_runs([k.bit_count() % 2 for k in range(1 << 12)]) == []  # the sequence without a cube


def expected_runs(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    drop = {i for start, q, size in found for i in range(start + q, start + size)}
    most = min(((-size, start, q) for start, q, size in found), default=None)
    lines = "".join(f"{start},{size},{q}\n" for start, q, size in found)
    best = (None,) * 4 if most is None else (most[1], -most[0], most[2], 1000 * -most[0] // most[2])
    return len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()


def test_runs_of_the_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = runs.op12_periodic_runs(spark, SMALL).collect()
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got)
    for r in got:
        assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == expected_runs(r["doc_id"], docs[r["doc_id"]])


def test_runs_of_awkward_rows(odd, none, spark, tmp_path):
    rows = runs.with_runs(odd).collect()
    assert sorted(rows[0].asDict()) == sorted(odd.columns)
    for r in rows:
        w = WORD.findall(r["text"] or "")
        if len(w) < 3000:
            want = plain_runs(w)
            assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == want
            drop = {i for start, q, size in want for i in range(start + q, start + size)}
            assert r["collapsed"] == (None if r["text"] is None else " ".join(x for i, x in enumerate(w) if i not in drop))
    assert runs.with_runs(none).count() == 0
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect():
        t = odd_texts()[r["doc_id"]]
        if len(t or "") < 3000:
            assert tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == expected_runs(r["doc_id"], t)


# --- collocations -----------------------------------------------------------------------------------

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_collocations(rows, longest=3, least=10, covered=50, top=2000):
    count, total = {}, Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                count.setdefault(lang or "und", Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in count.items():
        own = {k: v for k, v in own.items() if v >= least}
        found = []
        for x, a in own.items():
            if len(x) < 2:
                continue
            score, k = min((10**6 * a * a // (own[x[:k]] * own[x[k:]]), k) for k in range(1, len(x)))
            if not any(len(y) > len(x) and 100 * b >= covered * a and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1)) for y, b in own.items()):
                found.append((-score, -a, " ".join(x).encode(), own[x[:k]], own[x[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def told(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize(("longest", "least", "covered", "top"), [(3, 10, 50, 2000), (4, 3, 90, 7), (2, 2, 50, 50)])
def test_collocations_of_awkward_rows(odd, longest, least, covered, top):
    rows = [(t, ["en", "fr", None][k % 3]) for k, t in enumerate(odd_texts())]
    assert told(collocations.collocations(odd, longest=longest, least=least, covered=covered, top=top)) == plain_collocations(rows, longest, least, covered, top)


def test_collocations_with_a_crowded_sketch(odd, monkeypatch):
    """A sketch without room lets everything pass; counts stay exact. So do they over several shards and blocks."""
    rows = [(t, ["en", "fr", None][k % 3]) for k, t in enumerate(odd_texts())]
    want = plain_collocations(rows)
    for width, shard in ((1 << 4, 500), (1 << 17, 2000)):
        monkeypatch.setattr(collocations, "WIDEST", width)
        monkeypatch.setattr(collocations, "NARROWEST", width)
        monkeypatch.setattr(collocations, "BLOCK", 1 << 15)
        monkeypatch.setattr(collocations, "SHARD", shard)
        assert told(collocations.collocations(odd)) == want


@pytest.mark.parametrize(("longest", "least", "covered", "top"), [(3, 10, 50, 3), (4, 3, 90, 7), (3, 3, 50, 2000)])
def test_collocations_with_floors(odd, spark, monkeypatch, longest, least, covered, top):
    """Groups with a floor for their scores, too: those that can't fill their places above it are done again. Few phrases are counted then."""
    monkeypatch.setattr(collocations, "FLOORS", [(500, 125_000), (20, 8_000)])
    words = [f"w{k}" for k in range(12)]
    rng = random.Random(longest + top)
    rows = [(t, ["en", "fr", None][k % 3]) for k, t in enumerate(odd_texts())]
    rows += [(" ".join(x + ("" if rng.random() < 0.9 else ",") for _ in range(200) for x in rng.choice([["New", "York"], ["a", "b", "c", "d"], *[[w] for w in words]])), "many") for _ in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert told(collocations.collocations(docs, longest=longest, least=least, covered=covered, top=top)) == plain_collocations(rows, longest, least, covered, top)
    texts = docs.where("lang = 'many'").selectExpr("lang as group", "text")
    low, high = collocations.bounds_of_words(collocations.word_counts(texts, least))
    every, some = (collocations.phrase_counts(texts, 1 << 16, longest, low, high, floors, least)[0].count() for floors in ({}, {"many": 125_000}))
    assert 0 < some < every / 5


def test_collocations_of_the_query_and_nothing(spark, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_collocations([(r["text"], r["lang"]) for r in docs.collect()])
    assert told(collocations.op11_collocations(spark, SMALL)) == want
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
        assert sorted(con.execute(collocations.OP11_SQL).fetchall()) == want
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(docs.select("text", F.lit("x").alias("lang")).where("doc_id < 1")).count() >= 0


def test_scores_beyond_64_bits(spark):
    """Frequencies of billions, as the sums of counts may be."""
    rows = spark.createDataFrame([(4_000_000_000, 5_000_000_000, 6_000_000_000)], "a long, l long, r long")
    assert rows.select(collocations.score()).first()[0] == 10**6 * 4_000_000_000**2 // (5_000_000_000 * 6_000_000_000)
