"""The training-data operators against brute force, on small tables with the awkward cases."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperloom.llm import ann, bpe, exact_dedup, htmltext, langid, near_dedup, packing, pii, substring_dedup, toxicity
from paperloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, id2 int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts():
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    out = [None, "", " \n", "a", "Ä b  c\td", "one two three", "One two three", *base]
    for t in base[:6]:
        w = t.split()
        for k in (1, 2, 9):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "zz"
            out.append(" ".join(v))
    out += [base[0], base[0].replace(" ", "\n"), base[1] + " " + base[2], base[3].upper(), "x " * 3000, "é日" * 9000, "x " * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "clash", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, spark):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, support=0.04).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts()]
    for i, t in enumerate(norm):
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (norm.index(t), norm.count(t), norm.index(t) == i)
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_near(docs, spark):
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = list(range(len(sets)))
    for _ in own:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    own[i] = own[j] = min(own[i], own[j])
    got = {r["doc_id"]: r for r in near_dedup.near_groups(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(sets))] == own
    assert [got[i]["n_shingles"] for i in range(len(sets))] == [len(s) for s in sets]
    assert near_dedup.near_groups(empty(spark)).count() == 0


def test_near_in_blocks(docs, monkeypatch):
    whole = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()} == whole


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[100] == 0


@pytest.mark.parametrize("group", [4096, 1])
def test_substring(docs, spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeat_digests(docs).collect()}
    assert got == want
    assert substring_dedup.repeat_digests(empty(spark)).count() == 0


def test_private_data(spark):
    rng = random.Random(3)
    odd = ["a@b.c_d@e.f", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "0000255.1.1.1 999.1.1.1", "4111-1111  1111-1111 4111111111111111-", "1 " * 20000, "a." * 20000 + "@b.c", "+1 (269) 555-3296 x", None, ""]
    odd += ["".join(rng.choice("ab1 1234567890.-@+()_ é") for _ in range(100)) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")

    def base(t):
        found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
            if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
                found.append((m.start(), 2, m.end(), "card"))
        found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))

    for r in pii.private_spans(rows).collect():
        assert r["base_sha256"] == hashlib.sha256(base(odd[r["doc_id"]] or "").encode()).hexdigest(), odd[r["doc_id"]]
    near = "nothing here Quisling writes a.b@c.org daily , and"
    pair = spark.createDataFrame([(1, near), (2, near.replace("daily", "now")), (3, "clean daily text"), *[(i, "plain filler text") for i in range(4, 40)]], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.private_spans(pair).collect()}
    assert "term:13:21" in spans[1] and spans[3] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(pair).collect()}
    assert "[EMAIL]" in clean[1] and "Quisling" not in clean[1] and clean[3] == "clean daily text" and len(clean) == 39


def test_bpe():
    path = public_tokenizers.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    many = [t or "" for t in texts()] + ["aaaaaaaa" * 3000, "a\x85b", "a\x1cb", " x", "x ", "\n", "<|endoftext|>", "'s it's"]
    many += ["".join(rng.choice("ab é\n\t '.1,日 \x0b") for _ in range(40)) for _ in range(300)]
    own = bpe.Codec(path)
    ids = own.encode(many)
    assert ids.to_pylist() == [other.encode_ordinary(t) for t in many]
    assert own.decode(ids) == [t.encode() for t in many]


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [r.asDict() for r in packing.best_fit_packing(docs).collect()]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in enumerate(texts()):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids) and [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine[:-1]]]).tolist()
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.best_fit_packing(empty(spark)).count() == 0


def test_html():
    model = htmltext.default_model()
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>Tom &amp; Co</h1><p><b>One\n two.<br><p>Three  four.</p></article><footer>&copy; x</footer></body>"
    assert htmltext.main_text(page, model) == "Tom & Co\n\nOne two.\n\nThree four."
    assert htmltext.main_text(None, model) == htmltext.main_text("", model) == ""
    htmltext.main_text("<div>" * 3000 + "x", model)
    wrong = 0
    for html, mark in htmltext.labelled_pages(80, seed=99):
        got = htmltext.blocks_of(html, model)
        wrong += sum(b.count(mark) for b in got) != html.count(mark) or any(mark not in b for b in got)
    assert wrong <= 4


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc " if i % 2 else "xyz ") for _ in range(80)), "p" if i % 2 else "q") for i in range(200)]
    rows += [(900, None, "p"), (901, "12 34", "p"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = F.col("doc_id") % 3 == 1
    names, matrix = langid.train(docs.where(~fold))
    got = {r["doc_id"]: r for r in langid.predicted(docs, names, matrix, fold).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:200]) >= 198
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}


def test_toxicity(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        w = words(rng, 40).split()
        if i % 8 == 0:
            w[rng.randrange(40)] = rng.choice(["wormhead", "stinkrat"])
        rows.append((i, " ".join(w), int(i % 8 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs)
    assert (model.scores([t for _, t, _ in rows]) >= 0.5).astype(int).tolist() == [y for *_, y in rows]
    assert (model.scores(["b a wormxhead c", "so w.o.r.m.h.e.a.d", "w o r m h e a d"]) >= 0.5).all()
    assert (model.scores(["", "a b c", "x" * 5000]) < 0.5).all()
    assert toxicity.train(docs.where("toxic = 0")) is None
    # toxic rows without any word, or without any that stands out
    for text in (None, "", " ", "b"):
        odd = spark.createDataFrame([(i, text if i < 9 else "b c", int(i < 9)) for i in range(30)], "doc_id long, text string, toxic int")
        assert toxicity.train(odd) is None


def test_toxicity_of_held_out_rows(spark):
    """Labels of the small table that training doesn't see: recall and precision of 0.9 at least."""
    folder = "/root/testdata/sf0.01"
    told = toxicity.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    n = {(r["held_out"], r["toxic"], r["predicted"]): r["count"] for r in told.groupBy("held_out", "toxic", "predicted").count().collect()}
    for fold in (True, False):
        found, missed, false = n.get((fold, 1, 1), 0), n.get((fold, 1, 0), 0), n.get((fold, 0, 1), 0)
        assert found >= 0.9 * (found + missed) and found >= 0.9 * (found + false)


def test_witnesses_of_copies_and_rare_languages(spark):
    """Fillers of copied texts are no witnesses; a stem of few texts is one, once common insults are explained."""
    rng, rows = random.Random(3), []
    copied = words(rng, 50) + " wormhead"
    for i in range(600):
        w = words(rng, 40).split()
        if i % 8 == 0:
            w[rng.randrange(40)], w[rng.randrange(40)] = "wormhead", "stinkrat"
        elif i % 100 == 1:
            for k in range(3):
                w[10 * k + rng.randrange(10)] = f"zuqimo{rng.choice('abcd')}{k}"
        rows.append((copied if i % 8 == 0 and i > 400 else " ".join(w), int(i % 8 == 0 or i % 100 == 1)))
    found, stems = toxicity.witnesses(spark.createDataFrame(rows, "text string, label int"))
    assert {"wormhead", "stinkrat"} <= found and not found & (set(copied.split()) - {"wormhead"})
    assert any("zuqimo".startswith(x) for x in stems)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12))
    x[5] = x[6]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(900, None, ""), (901, [0.0] * 12, ""), (902, [float("nan")] * 12, ""), (903, [None] * 12, "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = {}
    for r in ann.neighbours(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {v for _, v, _ in found})
        assert [v for _, _, v in sorted(found)] == sorted((v for *_, v in found), reverse=True)
    assert set(got) == set(range(0, 600, 20)) and hits >= 0.9 * 20 * len(got)
    assert ann.neighbours(vectors.where("vec_id >= 900"), F.lit(True)).count() == 0


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "pii", "packing"]
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("n", [2, 10, 21, 30])
def test_neighbours_of_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 12))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(vectors, F.lit(True)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    most = min(20, n - 1)
    for q in range(n):
        want = sorted((i for i in range(n) if i != q), key=lambda i: -(x[i] @ x[q]))[:most]
        assert [v for _, v in sorted(got[q])] == want


def test_html_of_open_heads_and_foreign_elements():
    model = htmltext.default_model()
    body = "<article><h1>Tom and Co</h1><p>One two three four five.</p><p>Six seven eight nine ten.</p></article>"
    want = "Tom and Co\n\nOne two three four five.\n\nSix seven eight nine ten."
    assert htmltext.main_text(f"<html><head><title>T</title><meta charset=x><body>{body}", model) == want
    assert htmltext.main_text(f"<html><head><title>T</title><link href=x>{body}", model) == want
    assert htmltext.main_text(f"<html><head><title>T</title></head><body>{body}", model) == want
    drawn = body.replace("<p>Six", "<svg/><svg><path/><g/></svg><math/><p>Six")
    assert htmltext.main_text(f"<body>{drawn}</body>", model) == want
    assert [n.tag for n in htmltext.in_order(htmltext.parse("<svg><title/>x</svg><p>a</p>"))] == ["html", "p"]


def test_html_of_deep_pages():
    nodes = htmltext.in_order(htmltext.parse("<div>" * 1000 + "<p>a</p><p>b</p><div class=ad>c</div>"))
    assert len(nodes) == 1004 and [n.parts for n in nodes[-3:]] == [["a"], ["b"], ["c"]]
    assert "ad" in nodes[-1].kinds


def test_packing_of_added_tokens(docs, spark):
    import zlib

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    many = [*texts(), "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n z", "<|endoftext|", "long word <|endoftext|> " * 700]
    rows = [r.asDict() for r in packing.best_fit_packing(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")).collect()]
    for i, t in enumerate(many):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, packing.END]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_private_data_of_whole_texts(spark):
    gap = " common words of any text" * 20
    many = [f"Quisling wrote.{gap} to a.b@c.org first", f"Quisling said.{gap} to a.b@c.org second, Quisling", "clean Quisling text", *[f"plain filler text to{gap}"] * 40]
    many += [f"Vidkunna and{gap} x.y@z.org here", f"Vidkunna near x.y@z.org{gap}"]
    rows = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")

    terms = [re.findall(r"[^\W\d_]+", t.lower()) for t in many]
    mails = [set(re.findall(r"[a-z.]+@[a-z.]+", t)) for t in many]
    free = [set(re.findall(r"[^\W\d_]+", re.sub(r"[a-z.]+@[a-z.]+", " ", t.lower()))) for t in many]
    flagged = set()
    for e in set().union(*mails):
        for t in set().union(*free):
            n_te = sum(e in m and t in f for m, f in zip(mails, free, strict=True))
            n_t, n_e = sum(t in x for x in terms), sum(e in m for m in mails)
            if n_te >= 2 and 2 * n_te >= n_t and n_te * len(many) >= 8 * n_t * n_e:
                flagged.add(t)
    assert flagged == {"quisling", "vidkunna"}
    spans = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("term")] for r in pii.private_spans(rows).collect()}
    for i, t in enumerate(many):
        assert spans[i] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("Quisling|Vidkunna", t)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(rows).collect()}
    assert clean[2] == "clean  text" and clean[5] == many[5] and not any("Quisling" in t or "Vidkunna" in t for t in clean.values())


@pytest.mark.parametrize("percent, banding", [(85, (32, 7)), (80, (41, 6))])
def test_near_at_other_thresholds(spark, percent, banding):
    assert near_dedup.banding(percent) == banding
    w = [f"w{k}" for k in range(104)]
    other = lambda k: " ".join([*w[: 104 - k], *[f"z{k}-{j}" for j in range(k)]])  # noqa: E731 a similarity of (100 - k) / (100 + k)
    many = [other(0), other(5), other(9), other(11), other(12), None]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(100)} if t else set() for t in many]
    own = list(range(len(many)))
    for _ in own:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    own[i] = own[j] = min(own[i], own[j])
    rows = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(rows, percent=percent).collect()} == dict(enumerate(own))


def test_copy_stages_against_brute_force(docs, spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts()]
    kept = {r["doc_id"] for r in pipeline.without_copies(spark, docs, "").collect()}
    assert kept == {i for i, t in enumerate(norm) if norm.index(t) == i}
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = list(range(len(sets)))
    for _ in own:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    own[i] = own[j] = min(own[i], own[j])
    assert {r["doc_id"] for r in pipeline.without_near_copies(spark, docs, "").collect()} == {i for i, x in enumerate(own) if x == i}
