"""Awkward cases of every training-data operator, and brute-force versions of those that SQL can't express."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import ann, bpe, exact_dedup, htmltext, langid, near_dedup, packing, pii, shared, substring_dedup, tokens, toxicity

#: Names that operators use for columns of their own.
SCHEMA = "doc_id long, text string, lang string, toxic int, id long, row long, v string, prefix long, label int, rep long, token string, __x string"


def rows_of(texts):
    return [(i, t, "en", i % 2, 7, 7, "v", 7, 7, 7, "t", "x") for i, t in enumerate(texts)]


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [None, "", " \t\n", "one", "one", "two words", long, long, "日本語のテキスト", "a  b c d", "x" * 5000, "Mail a@b.co now", None]
    return spark.createDataFrame([*rows_of(texts), rows_of(["again"])[0], rows_of(["again"])[0]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def forms(docs):
    """Each operator over documents: a name and its result."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    matrix = langid.train(docs.where("text is not null"))
    model = toxicity.train(docs)
    yield "exact", exact_dedup.exact_groups(docs)
    yield "near", near_dedup.near_groups(docs)
    yield "substring", substring_dedup.repeat_digests(docs)
    yield "private", pii.private_spans(docs)
    yield "language", langid.predicted(docs, *matrix, F.lit(False))
    yield "toxicity", toxicity.scored(docs, model, F.lit(False))
    yield "bpe", bpe.round_trip_digests(docs, path)


def test_odd_rows_keep_their_number(odd):
    n = odd.count()
    for name, out in forms(odd):
        assert out.count() == n, name
    ids = [r["doc_id"] for r in packing.best_fit_packing(odd).where("piece = 0").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in odd.collect())


def test_filters_keep_columns(odd):
    for out in (exact_dedup.exact_dedup(odd), near_dedup.near_dedup(odd), pii.sanitised(odd), toxicity.without_toxic(odd, toxicity.train(odd))):
        assert out.columns == odd.columns and out.count() > 0


def test_filters_with_columns_of_their_own_names(odd):
    names = ["__kept_id", "__digest", "__gone", "__id", "__hash", "__id2", "__spans", "__text", "__base", "__free", "id", "c0", "c1"]
    docs = odd.select("doc_id", "text", *[F.lit(k).alias(x) for k, x in enumerate(names)])
    for out in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), pii.sanitised(docs), toxicity.without_toxic(docs, None)):
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}


def test_marginals_against_enumeration():
    """Sum-product messages give what summing over all states of small trees gives."""
    rng, model = random.Random(12), htmltext.default_model()

    def page(depth):
        inner = "".join(page(depth - 1) for _ in range(rng.randrange(3))) if depth else ""
        tag = rng.choice(["div", "p", "li", "section", "article", "h1", "td"])
        return f"<{tag} class='{rng.choice(['nav', 'post', 'x'])}'>{rng.choice(['', 'Some words here.', 'Menu'])}{inner}</{tag}>"

    seen = 0
    while seen < 25:
        nodes = htmltext.in_order(htmltext.parse(page(3)))
        if not 2 <= len(nodes) <= 11:
            continue
        seen += 1
        own = htmltext.features(nodes) @ model.weights * htmltext.tempers(nodes)
        place = {id(n): k for k, n in enumerate(nodes)}
        total, on = 0.0, np.zeros(len(nodes))
        for bits in range(1 << len(nodes)):
            state = [bits >> k & 1 for k in range(len(nodes))]
            log = model.root * state[0] + sum(own[k] for k in range(len(nodes)) if state[k])
            log += sum(model.edges.get(n.tag, model.edges["other"])[state[place[id(n.parent)]]][state[k]] for k, n in enumerate(nodes) if k)
            total += math.exp(log)
            on += np.array(state) * math.exp(log)
        assert np.abs(model.marginals(nodes) - on / total).max() < 1e-9


def test_articles_of_short_sentences():
    model, menu = htmltext.default_model(), "<nav><a href='/x'>Home</a></nav>"
    for frame in ("article", "main"):
        for many in (1, 2, 5, 40):
            for text in ("Short one.", "Short one"):
                got = htmltext.main_text(f"{menu}<{frame}><h1>Some heading of it</h1>{f'<p>{text}</p>' * many}</{frame}>", model)
                assert got == "\n\n".join(["Some heading of it", *[text] * many])


def test_no_page_loses_its_article(spark):
    """On pages with an article element, its own blocks come out, none lost and none added."""
    model = htmltext.default_model()

    class Frame:
        def marginals(self, nodes):
            inside = {}
            for n in nodes:
                inside[id(n)] = n.tag == "article" or n.parent is not None and inside[id(n.parent)]
            return np.array([float(inside[id(n)]) for n in nodes])

    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect() if r["html"] and "<article" in r["html"]]
    assert pages and not [x for x in pages if htmltext.main_text(x, model) != htmltext.main_text(x, Frame())]


def test_empty_tables(none):
    for name, out in forms(none):
        assert out.count() == 0, name
    assert packing.best_fit_packing(none).count() == 0
    pages = none.select(F.col("id").alias("page_id"), F.col("v").alias("url"), F.col("text").alias("html"))
    assert htmltext.extracted(pages).count() == 0


def test_pages_with_clashing_columns_and_repeats(spark):
    page = "<body><article><p>One two three four five six.</p><p>Seven eight nine ten eleven.</p></article></body>"
    pages = spark.createDataFrame([(1, "u", page, "old", -1), (1, "u", page, "old", -1), (2, "u", None, "old", -1), (3, "u", "", "old", -1)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extracted(pages).collect())
    want = "One two three four five six.\n\nSeven eight nine ten eleven."
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]


def test_words_with_equal_polynomial_hashes(spark):
    """A Thue-Morse word and its complement have equal hashes by any polynomial modulo a power of two."""
    u, v = thue_morse(1024), thue_morse(1024, "b", "a")
    fill = [f"w{k}" for k in range(19)]
    texts = [" ".join([u, *fill]), " ".join([v, *fill])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.repeat_digests(docs).orderBy("doc_id").collect()] == [0, 0]
    shingles = [" ".join([*fill[:10], x, *fill[10:]]) for x in (u, v)]
    docs = spark.createDataFrame(list(enumerate(shingles)), "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_groups(docs).orderBy("doc_id").collect()] == [0, 1]


def test_substring_of_repeated_ids(spark):
    w, other = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, w), (5, w), (5, other)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substring_dedup.repeat_digests(docs).collect()}
    assert got == {(1, 20): 0, (5, 20): 20, (5, 30): 0}


@pytest.mark.parametrize("group, heavy", [(4096, 1.0), (1, 0.0)])
def test_substring_against_windows(spark, monkeypatch, group, heavy):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(400)]
    texts = []
    for _ in range(60):
        at, n = rng.randrange(380), rng.randrange(60)
        texts.append(" ".join([f"n{rng.random()}", *base[at : at + n], *["x"] * rng.randrange(50)]))
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeat_digests(docs).collect()} == want


def test_tree_nodes():
    rng = random.Random(1)
    words = np.array([rng.randrange(2) for _ in range(500)])
    node = substring_dedup.tree_nodes(words, 7)
    of = {}
    for k, x in enumerate(node.tolist()):
        assert of.setdefault(tuple(words[k : k + 7]), x) == x
    assert len(of) == len(set(node.tolist()))


def test_signatures_in_parts(monkeypatch):
    texts = pa.array([" ".join(f"w{k * j}" for k in range(200)) for j in range(1, 6)] + [None, "a b"])
    hashes, first = near_dedup.shingle_sets(texts)
    whole = near_dedup.signatures(hashes, first, 224)
    monkeypatch.setattr(near_dedup, "PART_SHINGLES", 37)
    assert (near_dedup.signatures(hashes, first, 224) == whole).all()


def test_prefix_filter_misses_no_link():
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"z{rng.randrange(9)}"
        texts.append(" ".join(w[rng.randrange(3) :]))
    hashes, first = near_dedup.shingle_sets(pa.array(texts))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
    seen = near_dedup.shared_prefixes(hashes, first, 85)
    for i, j in combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            assert seen[i, j] > 0


def test_private_terms_at_either_end(spark):
    many = ["Quisling a.b@c.org wrote", "said a.b@c.org Quisling", *[f"plain filler text {k}" for k in range(40)], "no Quisling here; Quisling"]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.private_spans(docs).collect()}
    assert spans[0].startswith("term:0:8,email:9:18") and spans[1].endswith("term:15:23")
    assert spans[42].split(",") == ["term:3:11", "term:18:26"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert not any("Quisling" in x for x in clean.values())


def test_many_spans_in_one_text(spark):
    n = 3000
    docs = spark.createDataFrame([(0, "é 1.2.3.4 und " * n)], "doc_id long, text string")
    r = pii.private_spans(docs).first()
    assert r["n_ip"] == n
    want = ",".join(f"ip:{14 * k + 2}:{14 * k + 9}" for k in range(n))
    assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert pii.sanitised(docs).first()["text"] == "é [IP] und " * n


def test_language_against_plain_naive_bayes(spark):
    rng = random.Random(4)
    words = {"p": "der die und ich nicht das".split(), "q": "the and you not that is".split()}
    rows = [(i, " ".join(rng.choices(words["pq"[i % 2]], k=12)), "pq"[i % 2]) for i in range(60)]
    names, matrix = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == ["p", "q"]
    counts = {x: {} for x in names}
    for _, t, y in rows:
        for b, _ in [(b, o) for buckets, owners in langid.n_grams([t]) for b, o in zip(buckets.tolist(), owners.tolist(), strict=True)]:
            counts[y][b] = counts[y].get(b, 0) + 1
    test = ["die das the", "and not that und", "²", "½ 12", "é", None, ""]
    got = {r["doc_id"]: r for r in langid.predicted(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), names, matrix, F.lit(True)).collect()}
    size = 1 << langid.BUCKET_BITS
    for i, t in enumerate(test):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        log = []
        for y in names:
            total = sum(counts[y].values()) + 0.5 * size
            log.append(sum(math.log((counts[y].get(b, 0) + 0.5) / total) for buckets, _ in langid.n_grams([t]) for b in buckets.tolist()))
        best = max(log)
        odds = [math.exp(x - best) for x in log]
        assert got[i]["lang_pred"] == names[log.index(best)] and abs(got[i]["score"] - 1 / sum(odds)) < 1e-3


def test_sample_bounds_hold_for_any_size():
    for rows, n in ((4_000, 10**10), (20_000, 10**12)):
        bound = min((1 << 63) - 1, int(min(1.0, rows / n) * 2**64) - (1 << 63))
        assert -(1 << 63) < bound and abs((bound + (1 << 63)) / 2**64 * n - rows) < 1


def test_kernel_against_subsequences():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(3, 14))) for _ in range(40)]
    marks = words[:5] + ["abc", "deabc"]

    def features(x):
        out = {}
        for i, j, k in combinations(range(len(x)), 3):
            key = x[i] + x[j] + x[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    dot = lambda a, b: sum(v * b.get(u, 0) for u, v in a.items())
    phi, psi = [features(x) for x in words], [features(x) for x in marks]
    want = np.array([[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in psi] for a in phi])
    assert np.abs(toxicity.kernel(words, marks) - want).max() < 1e-5
    weights = np.random.default_rng(1).normal(size=len(marks))
    assert np.abs(toxicity.Model(marks, weights, -0.2).decision(words) - (want @ weights - 0.2)).max() < 1e-4


def test_units_of_all_scripts():
    assert toxicity.units_of("ab") == [" ab "] and toxicity.units_of("...") == []
    assert toxicity.units_of("i.d-i_ot") == ["idiot"]
    assert toxicity.units_of("馬鹿野郎だ") == ["馬鹿野郎", "鹿野郎だ"]
    assert "".join(sorted(set("".join(toxicity.units_of("abcdefghij" * 9))))) == "abcdefghij"


def test_digests_against_tiktoken(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(3)
    many = [None, "", "x" * 3000, "=" * 2000, " \n ", "a\x00b c"] + ["".join(rng.choice("the quick,\n brown. éß日1 ") for _ in range(rng.randrange(200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(2)
    for r in bpe.round_trip_digests(docs, path).collect():
        text = many[r["doc_id"]] or ""
        ids = other.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_coders_on_parts_of_arrays(monkeypatch):
    rng = random.Random(6)
    many = ["".join(rng.choice("ab cd.\né ") for _ in range(300)) for _ in range(50)]
    own = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    whole = own.encode(many).to_pylist()
    assert own.encode(pa.array(many).slice(13, 30)).to_pylist() == whole[13:43]
    assert own.encode(pa.array(["pad" * 99, *many], pa.string()).slice(1)).to_pylist() == whole
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    assert own.encode(many).to_pylist() == whole
    words, count = shared.words_of(pa.array(many).slice(13, 30), lower=True)
    listed = words.to_pylist()
    for k, t in enumerate(many[13:43]):
        assert [x.encode() for x in listed[count[k] : count[k + 1]]] == t.encode().lower().split()
    batch = pa.RecordBatch.from_pydict({"text": many})
    assert [x for part in shared.slices(batch, "text", 700) for x in part.column("text").to_pylist()] == many


def test_ranks_out_of_order():
    """A vocabulary whose ranks don't follow its merges: one merge at a time decides."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 400, b"abc": 300, b"bc": 500, b"ca": 350}
    other = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Vocabulary.of_ranks(ranks)
    rng = random.Random(9)
    many = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 12))) for _ in range(400)]
    many = [x for x in many if x.encode() not in ranks]
    ids, size = own.merged(pa.array(many))
    ends = np.cumsum(size)
    for x, a, b in zip(many, ends - size, ends, strict=True):
        assert ids[a:b].tolist() == other.encode_ordinary(x), x


def test_packing_ties_and_bins(spark):
    rng = random.Random(8)
    counts = {}
    for _ in range(500):
        n = rng.choice([1, 7, 300, 341, 342, 400, 600, 682, 683, 1000, 1024, rng.randint(1, 1024)])
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan(counts)
    bins, used = {}, dict.fromkeys(counts, 0)
    for n, rows in plan.groupby("length"):
        firsts = [*rows.sort_values("first")["first"], counts[n]]
        for r, end in zip(rows.sort_values("first").itertuples(), firsts[1:], strict=True):
            for k in range(end - r.first):
                bins.setdefault(r.sequence + k, []).append((r.offset, n))
                used[n] += 1
    assert used == counts
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024 and sum(3 * n > 1024 for _, n in b) <= 2
    best: list[int] = []  # plain best fit, from the largest down
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        room = [k for k, left in enumerate(best) if left >= n]
        if room:
            best[min(room, key=best.__getitem__)] -= n
        else:
            best.append(1024 - n)
    assert len(bins) <= len(best) * 1.02 + 1


def test_packing_digests(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    many = [None, "", "a b c", "word " * 3000, "日本 é\n\nx", "a b c"]
    rows = packing.best_fit_packing(spark.createDataFrame([(i % 5, t) for i, t in enumerate(many)], "doc_id long, text string")).collect()
    want = []
    for i, t in enumerate(many):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, packing.END]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            piece = ids[start : first if k == 0 else start + 1024]
            want.append((i % 5, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_neighbours_scores_and_ties(spark):
    x = np.random.default_rng(5).normal(size=(40, 6)).round(1)
    x[7] = x[9] = x[11]
    vectors = spark.createDataFrame([(i, v.tolist(), [1.0]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, keys array<double>")
    for r in ann.neighbours(vectors, F.col("vec_id") % 2 == 0).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found")).collect():
        q = r["query_id"]
        want = sorted((i for i in range(40) if i != q), key=lambda i: (-float(np.dot(x[q], x[i])), i))[:20]
        assert [(f["rank"], f["vec_id"]) for f in r["found"]] == list(enumerate(want, 1))
        assert [f["score"] for f in r["found"]] == [float(np.dot(x[q], x[i])) for i in want]


def test_scratch_must_be_shared():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.scratch_dir(Session())


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: rejected, equal and near texts go, personal data goes, and every token is packed once."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    # toxicity
    model = toxicity.fit_on_tables(spark, docs, "/root/testdata/sf0.001")
    kept = {r["doc_id"] for r in pipeline.without_toxic(spark, docs, "/root/testdata/sf0.001").collect()}
    assert kept == {i for i, t in before.items() if model is None or model.scores([t or ""])[0] < 0.5}
    # exact copies
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in before.items()}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    kept = {r["doc_id"] for r in pipeline.without_copies(spark, docs, "").collect()}
    assert kept == set(first.values())
    # near copies
    sets = {}
    for i, t in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    own = {i: i for i in sets}
    for _ in range(9):
        for i, j in combinations(sorted(sets), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                own[i] = own[j] = min(own[i], own[j])
    kept = {r["doc_id"] for r in pipeline.without_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, x in own.items() if i == x}
    # personal data
    clean = pipeline.without_private_data(spark, docs, "").collect()
    assert {r["doc_id"] for r in clean} == set(before) and all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in clean:
        assert not mail.search(r["text"] or "") and (r["text"] or "").count("[EMAIL]") >= len(mail.findall(before[r["doc_id"]] or "")) - (before[r["doc_id"]] or "").count("+")
    # packing
    packed = pipeline.into_sequences(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    coder = packing.coder(public_tokenizers.path(packing.VOCABULARY))
    _, ends = coder.texts(pa.array([before[r["doc_id"]] for r in packed], pa.string()))
    assert [r["n"] for r in packed] == (np.diff(ends) + 1).tolist() and len(packed) == len(before)
