"""Every operator and stage with clashing columns, null and repeated ids, and empty tables: the same results as without."""

import bisect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperledger.llm import exact_dedup, line_dedup, mixing, packing, pii, quality, queries, secret_scan, shingle_join, url_filter, vector_topk, wordhash
from tests.llm.test_operators import brute_pii

CLASH = ("_id", "_key", "_size", "_source", "_row", "key", "doc_id2", "row", "number", "salt", "which", "label", "by", "size", "none", "id", "text_sha256", "digest", "part", "at", "at_", "rank", "block", "d", "score", "removed_", "times", "cut", "salts", "n", "h1")


def clashing(df):
    return df.withColumns({c: F.lit(f"x{i}") if i % 2 else F.lit(float(i)) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(8, 40))) for _ in range(30)]
    texts = [*base, *base[:5], base[6] + " more", "call 415-223-4567 or a.b@mail.com\ntoken=abcdefgh12", None, "", "\n".join(base[:3]), "\n".join(["own", *base[:3], "end"])]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], 1) for i, t in enumerate(texts)]
    rows += [(None, base[3] + " null", "en", "a", 1), (None, None, None, None, None), (7, base[7], "en", "b", 1), (7, "another text of the same id with words of its own", "en", "b", 1), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).persist()


def same(a, b):
    key = lambda r: repr(sorted((k, str(v)) for k, v in r.asDict(True).items()))
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


OPERATORS = {
    "pii": lambda d: pii.find_personal_data(d),
    "mixing": lambda d: mixing.mix(d),
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "shingle": lambda d: shingle_join.shingle_components(d),
    "secret": lambda d: secret_scan.scan_secrets(d),
    "packing": lambda d: packing.pack(d, queries.tokenizer()).groupBy("doc_id", "start", "length", "ids_crc32", "doc_tokens").count(),
    "url": lambda d: url_filter.judge(d, id_col="doc_id", url_col="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, docs, name):
    run = OPERATORS[name]
    plain = run(docs)
    assert same(plain, run(clashing(docs)))
    none = run(clashing(docs).limit(0))
    assert none.columns == plain.columns and none.count() == 0


def test_vectors_with_other_columns(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0 - i]) for i in range(60)], "vec_id long, embedding array<double>")
    c = clashing(v).withColumn("d", F.lit("x"))
    assert same(vector_topk.top_k(v, v.where("vec_id % 50 = 0")), vector_topk.top_k(c, c.where("vec_id % 50 = 0")))


STAGES = {
    "exact": exact_dedup.drop_copies,
    "shingle": shingle_join.drop_near_copies,
    "mixing": mixing.mixed,
    "lines": line_dedup.line_dedup,
}


@pytest.mark.parametrize("name", STAGES)
def test_rows_go_along_whole(spark, docs, name):
    run = STAGES[name]
    plain, more = run(docs), run(clashing(docs))
    assert [c for c in more.columns if c not in CLASH] == plain.columns
    assert same(plain, more.select(*plain.columns))
    assert {tuple(r) for r in more.select(*CLASH).distinct().collect()} == {tuple(r) for r in clashing(docs).select(*CLASH).distinct().collect()}
    assert run(clashing(docs).limit(0)).count() == 0


def test_quality_with_other_columns(spark, docs):
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    model, again = quality.fit(docs, marks), quality.fit(clashing(docs), clashing(marks))
    assert np.allclose(model.weight, again.weight) and same(quality.score(docs, model), quality.score(clashing(docs), again))
    kept = quality.drop_low(clashing(docs), model)
    assert same(quality.drop_low(docs, model), kept.select(*docs.columns))
    assert quality.fit(docs, marks.limit(0)).bias == 0


def test_stages_of_an_empty_table(spark, tmp_path):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_quality_against_plain_python(spark):
    """Log-count ratios, the dual's gap and scores, without the operator's arrays."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("aa", "bb", "cc", f"w{rng.randrange(40)}")) for _ in range(12)) + (" zz qq" if i % 3 else " yy rr") for i in range(60)]
    y = np.array([1 if i % 3 else -1 for i in range(60)])
    rows = [r for _, r in quality.features(pa.array(texts))]
    ratio = quality.log_ratio(rows, y)
    size = 1 << quality.BITS
    counts = {k: [quality.SMOOTH] * size for k in (1, -1)}
    for r, k in zip(rows, y, strict=True):
        for f in r:
            counts[int(k)][f] += 1
    sums = {k: sum(v) for k, v in counts.items()}
    for f in {int(f) for r in rows for f in r}:
        assert ratio[f] == pytest.approx(np.log(counts[1][f] / sums[1]) - np.log(counts[-1][f] / sums[-1]))
    values = [quality._scaled(r, ratio) for r in rows]
    cost = np.full(60, 0.7)
    w, bias = quality.dual_coordinate_descent(rows, values, y, cost, 2000)
    margins = np.array([sum(w[f] * v for f, v in zip(r, x, strict=True)) + bias for r, x in zip(rows, values, strict=True)])
    primal = 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - y * margins)).sum()
    # Strong duality: at the optimum |w|^2 + bias^2 = sum of alpha - the dual's value, so primal = sum(alpha) - 0.5 |w|^2.
    best = min(0.5 * (s * s) * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - s * y * margins)).sum() for s in np.linspace(0.9, 1.1, 41))
    assert primal <= best * 1.001
    model = quality.fit_rows(rows, y, 2 / 3)
    for t, r, s in zip(texts, rows, quality._scorer(model)(pa.array(texts)), strict=True):
        x = [model.ratio[f] for f in r]
        margin = sum(model.weight[f] * v for f, v in zip(r, x, strict=True)) / (sum(v * v for v in x) ** 0.5 or 1) + model.bias
        assert s == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift)))), t


def test_sample_bound_is_even_and_free_of_layout(spark):
    texts = [f"good words number {i} " + " ".join(f"g{i}x{j}" for j in range(30)) for i in range(40)] + [f"&&& bad {i} " + " ".join(f"b{i}y{j}" for j in range(30)) for i in range(40)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    small = [quality.fit(x, marks, per_class_features=2000) for x in (d.orderBy("doc_id").coalesce(1), d.repartition(5), d.orderBy(F.desc("doc_id")))]
    assert all(np.allclose(m.weight, small[0].weight) for m in small) and small[0].weight.any()


def test_long_texts_need_little():
    """64 MB of words through hashing, features, shingles and ids: some multiples of the hashes, in slices."""
    import tracemalloc

    word = b"lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor "
    text = pa.array([(word * (1 + (16 << 20) // len(word)))[: 16 << 20].decode()])
    sizes = {}
    for name, use in (("features", lambda: list(quality.features(text))), ("tokens", lambda: list(shingle_join.token_sets(text))), ("ids", lambda: list(packing.Encoder(queries.tokenizer()).encode(text)))):
        tracemalloc.start()
        use()
        sizes[name] = tracemalloc.get_traced_memory()[1] / (16 << 20)
        tracemalloc.stop()
    assert max(sizes.values()) < 16, sizes


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_change_no_hash(monkeypatch, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab c\n") * rng.choice((1, 1, 9)) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    whole = [[x.tolist() for x in (*wordhash.words(d, o), *wordhash.shingles(*wordhash.words(d, o)[:2], 3))] for _, _, d, o in wordhash.chunks(pa.array(texts))]
    for name, value in (("SLICE", size), ("_UP", wordhash._powers(wordhash._BASE, size + 1)), ("_DOWN", wordhash._powers(wordhash._INVERSE, size + 1))):
        monkeypatch.setattr(wordhash, name, value)
    assert whole == [[x.tolist() for x in (*wordhash.words(d, o), *wordhash.shingles(*wordhash.words(d, o)[:2], 3))] for _, _, d, o in wordhash.chunks(pa.array(texts))]


def test_long_text_is_scored_like_short_ones(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(("aa", "bb", "bb bb bb bb", "c&c", "é")) for _ in range(4000))
    plain = [r.tolist() for _, r in quality.features(pa.array([text]))]
    monkeypatch.setattr(wordhash, "CHUNK", 1000)
    assert [r.tolist() for _, r in quality.features(pa.array([text]))] == plain


def test_any_tokenizer_gives_its_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello  World", "", "don't\n\tstop 12345 é", "x" * 100]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        whole, own = Tokenizer.from_file(path), packing.Encoder(path)
        assert own.by_word == name.startswith("word")
        assert [i.tolist() for _, i in own.encode(pa.array(texts))] == [[*whole.encode(t, add_special_tokens=False).ids, packing.END] for t in texts]


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    texts = ["alpha beta gamma alpha", "a long word internationalisation beta", "internationalization alpha"]
    own = packing.Encoder(queries.tokenizer())
    right = [i.tolist() for _, i in own.encode(pa.array(texts))]
    real = wordhash.words

    def poor(data, offsets, lower=True):
        h, *rest = real(data, offsets, lower)
        return (h % np.uint64(3), *rest)

    monkeypatch.setattr(wordhash, "words", poor)
    assert [i.tolist() for _, i in packing.Encoder(queries.tokenizer()).encode(pa.array(texts))] == right


def test_cache_of_words_has_a_bound(monkeypatch):
    """1.7 million different words: a worker's cache holds 100 MB at most."""
    own = packing.Encoder(queries.tokenizer())
    monkeypatch.setattr(own, "_ids", lambda words: [(1, 2, 3, 4)] * len(words))
    for a in range(0, 1_700_000, 100_000):
        for _, ids in own.encode(pa.array([" ".join(f"w{i:x}" for i in range(a, a + 100_000))])):
            assert len(ids) == 400_001 and ids.dtype == np.uint32 and ids[-5:].tolist() == [1, 2, 3, 4, packing.END]
        held = [own.flat, own.first, *own.looks, own.table.keys, own.table.numbers]
        assert sum(x.nbytes for x in held) < 100 << 20


def test_personal_data_in_a_long_text(spark):
    """Thousands of spans of several kinds in one text, by the sums over blocks and stretches."""
    rng = random.Random(5)
    parts = ["a.b@mail.com", "4111 1111 1111 1111", "10.0.0.1", "+1 (017) 555-7713", "415-223-4567", "415-22-1234", "word", "é🙂", "x@y.de", "IBAN DE89370400440532013000"]
    text = " ".join(rng.choice(parts) for _ in range(6000))
    rows = pii.find_personal_data(spark.createDataFrame([(1, text), (2, "415-223-4567 and a.b@mail.com"), (3, None)], "doc_id long, text string")).collect()
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in rows}
    base = brute_pii(text)
    assert [s for s in found[1] if s[0] in pii.BASE] == base and len(base) > 2000 and found[3] == []
    weak = [s for s in found[1] if s[0] not in pii.BASE]
    ends = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in ends]
    for _, s, e in weak:
        i = bisect.bisect_left(starts, e)
        assert not any(a < e and s < b for a, b in ends[max(0, i - 3) : i])
    assert {text[s:e] for k, s, e in weak if k == "local"} <= {"415-223-4567"} and weak


def test_span_classifier_counts():
    """Its weights are the log odds of features by chances, against plain sums."""
    said = [("local", (7, 9), 0.9), ("local", (7, 11), 0.2), ("ssn", (13, 9), 0.6)]
    sums, totals = {}, {}
    for kind, features, c in said:
        y, n = totals.get(kind, (0.0, 0.0))
        totals[kind] = (y + c, n + 1 - c)
        for f in features:
            k, y, n = sums.get(f, (pii.KINDS.index(kind), 0.0, 0.0))
            sums[f] = (max(k, pii.KINDS.index(kind)), y + c, n + 1 - c)
    weights, prior = pii.weights([(f, *v) for f, v in sums.items()], totals)
    assert prior["local"] == pytest.approx(np.log((1.1 + pii.SMOOTH) / (0.9 + pii.SMOOTH)))
    spread = pii.SMOOTH * pii.SPREAD
    assert weights[7] == pytest.approx(np.log((1.1 + pii.SMOOTH) / (1.1 + spread)) - np.log((0.9 + pii.SMOOTH) / (0.9 + spread)))
    assert weights[11] < 0 < weights[7] + 1 and weights[100] == 0.0
