"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperledger.llm import automaton, components, exact_dedup, line_dedup, mixing, packing, pii, quality, queries, secret_scan, shingle_join, signature_tree, url_filter, vector_topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key int, norm string, _times int"


def table(spark, texts, sources=None):
    """Documents of these texts, with extra columns whose names operators use inside."""
    rows = [(i, t, None, (sources or ["s"] * len(texts))[i], None, "x", 1, None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, pool=40):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(0, 60), 400) for _ in range(60)]
    out = [None, "", "  \n ", "One  two", "one two", "x" * 30_000, " ".join(f"v{i}" for i in range(20_000))]
    for t in base:
        out.append(t)
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                if v:
                    v[rng.randrange(len(v))] = f"z{rng.randrange(9)}"
            out.append(" ".join(v).upper() if rng.random() < 0.2 else " ".join(v))
    return out + ["same text of several words here"] * 40


def test_exact_dedup(spark, mixed_texts):
    docs = table(spark, mixed_texts)
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in mixed_texts]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs.repartition(5)).collect()}
    for i, t in enumerate(norm):
        own = groups[t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (own[0], len(own), own[0] == i)
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(g[0] for g in groups.values())
    assert exact_dedup.drop_copies(docs.unionAll(docs)).count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for j, b in enumerate(sets):
        for i in range(j):
            a = sets[i]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("split", [False, True])
def test_shingle_join(spark, mixed_texts, monkeypatch, split):
    if split:  # every token counts as frequent, buckets and components are dealt by pairs of blocks
        for name, value in (("OFTEN", 2), ("SPLIT", 3), ("BLOCK_TOKENS", 60), ("WINDOW", 500)):
            monkeypatch.setattr(shingle_join, name, value)
    docs = table(spark, mixed_texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.shingle_components(docs).collect()}
    assert [got[i] for i in range(len(mixed_texts))] == brute_components(mixed_texts)
    if not split:
        kept = shingle_join.drop_near_copies(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})
        assert shingle_join.shingle_components(docs.limit(0)).count() == 0


def test_shingle_ties(spark):
    """9 of 10 shingles common in sets of 9 and 10 is a link; just below 0.8 is none."""
    w = [f"t{i}" for i in range(14)]
    texts = [" ".join(w[:12]), " ".join(w[:14]), " ".join(w[2:14])]
    got = [r.component_id for r in shingle_join.shingle_components(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == [c for _, c in brute_components(texts)] == [0, 0, 0]


@pytest.mark.parametrize("posted", [1, 4])
def test_group_of_near_copies_makes_few_edges(monkeypatch, posted):
    """A bucket of 1,600 near copies and some pairs, split where it is posted or after: all are joined, by about as many
    edges as members, with either block pairs of candidates or of links."""
    rng = np.random.default_rng(8)
    make = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    core, pairs = make(60), [make(50) for _ in range(200)]
    sets = [np.unique(np.r_[core, make(3)]) for _ in range(1600)] + [np.unique(np.r_[x, make(2)]) for x in pairs for _ in range(2)]
    cls = np.sort(rng.integers(-(1 << 62), 1 << 62, len(sets)))
    monkeypatch.setattr(shingle_join, "SMALL", 128)
    own, other = rng.integers(0, posted, len(sets)), np.arange(posted)
    low, high = np.minimum(own[:, None], other), np.maximum(own[:, None], other)
    rows = (low * posted + high).ravel(), np.repeat(cls, posted), shingle_join._sides(np.repeat(own, posted), np.tile(other, len(sets)))
    order = np.lexsort(rows[1::-1])
    dealt = pa.Table.from_batches(shingle_join._buckets(iter([pa.RecordBatch.from_arrays([pa.array(x[order]) for x in rows], ["key", "cls", "side"])]))).sort_by([("bucket", "ascending"), ("cls", "ascending")])
    at = np.searchsorted(cls, dealt.column("cls").to_numpy())
    more = {"rep": pa.array(at), "n": pa.array([len(sets[i]) for i in at], pa.int32()), "bits": pa.array([signature_tree.bitmap(sets[i]).tobytes() for i in at]), "tokens": pa.array([sets[i].tobytes() for i in at])}
    names, side = dealt.column("bucket"), dealt.column("side")
    for found, given in ((shingle_join._may_link, ("rep", "n", "bits")), (shingle_join._link, ("rep", "n", "tokens"))):
        batches = pa.table([names, *(more[k] for k in given), side], ["bucket", *given, "side"]).combine_chunks().to_batches()
        edges = pa.Table.from_batches(found(iter(batches)))
        nodes, of = components.least_reached(*(edges.column(k).to_numpy() for k in ("a", "b")))
        assert nodes.tolist() == list(range(len(sets)))
        assert of.tolist() == [0] * 1600 + [i - i % 2 for i in range(1600, len(sets))]
        assert len(edges) < 1.2 * len(sets)


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        core = rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)
        for _ in range(8):
            keep = core[rng.random(len(core)) < 0.93]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 9), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for a, b in shingle_join.candidates([signature_tree.bitmap(s) for s in sets], sizes, None) for p in zip(a.tolist(), b.tolist())}
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (sizes[i] + sizes[j])}
    assert linked and linked <= found and len(found) < len(sets) ** 2 / 4


@pytest.mark.parametrize("few", [0, 40, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in of.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_mixing(spark):
    rng = random.Random(8)
    texts, sources = [], []
    for i in range(900):
        texts.append(words(rng, rng.randint(1, 40)))
        sources.append(rng.choice(["a", "a", "a", "a", "b", "c", "d", None]))
    texts[3], texts[4], sources[5] = None, "", "tiny"
    texts[5] = "only three words"
    docs = table(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect())
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len((t or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        goal = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if goal[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == size[s]
        assert r.target == pytest.approx(goal[s]) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in order)
    for s in order:  # complete epochs come first: counts within a source differ by one at most
        times = {r.taken // r.size for r in rows if sources[r.doc_id] == s and r.size}
        assert max(times) - min(times) <= 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.taken // r.size for r in rows if r.taken})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_prefers_heavy_documents(spark):
    docs = table(spark, ["ten words " * 5] * 400 + ["&&& %%% " * 5] * 400, ["b"] * 800).withColumn("source", F.lit("b"))
    more = docs.unionAll(table(spark, ["x y"] * 800).withColumn("source", F.lit("a")))
    rows = [r for r in mixing.mix(more).collect() if r.size == 10]
    good = sum(r.taken for r in rows if r.doc_id < 400)
    assert good > 3 * sum(r.taken for r in rows if r.doc_id >= 400)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://net/", "net", "/", "net/", "block"),
        ("https://a.b.NET/x?y", "a.b.net", "/x", "net/", "block"),
        ("http://xnet/", "xnet", "/", None, "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://x.example.net/en/1#q", "x.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("http://a.example.com/de/?x", "a.example.com", "/de/", "example.com/de/", "block"),
        ("http://a.example.com/de", "a.example.com", "/de", None, "allow"),
        ("http://z.org/fr/q", "z.org", "/fr/q", "org/fr/", "allow"),
        ("http://z.org/FR/q", "z.org", "/FR/q", None, "allow"),
        ("x://h?a://b.net/", "h", "", None, "allow"),
        ("nothing.net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://www.cheap-pills.example.com/en/", "www.cheap-pills.example.com", "/en/", None, "block"),
        ("http://docs.casino.example.com/casino/", "docs.casino.example.com", "/casino/", None, "allow"),
    ],
)
def test_url_filter(spark, url, host, path, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


@pytest.mark.parametrize("most_bytes", [url_filter.MOST_BYTES, 0])
def test_url_index_runs_few_rules_and_misses_none(spark, most_bytes):
    rules = tuple(url_filter.pattern_rule("block", f"/spam{i}/page^") for i in range(30_000)) + (url_filter.pattern_rule("block", "x*y"), url_filter.host_rule("allow", "q.com"), url_filter.host_rule("block", "q.com"))
    found = url_filter.index(rules)
    assert [t for t, r in found].count("") == 1 and len({t for t, _ in found}) >= 30_001
    urls = [f"http://h/a/spam{i}/page" for i in range(0, 30_000, 700)] + ["http://h/axby", "http://h/spam1/pages", "http://h/spam10/page/", "http://q.com/spam1/page", "http://h/" + "long/" * 50_000 + "spam7/page", None, "http://h/spam10/page/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://h/spam5/page")] * 2, "page_id int, url string")
    rows = url_filter.judge(pages, rules, most_bytes=most_bytes).collect()
    assert [r.verdict for r in rows if r.page_id is None] == ["block"] * 2 and len(rows) == len(urls) + 2
    rows = {r.page_id: r for r in rows}
    for i, u in enumerate(urls):
        hit = u is not None and "q.com" not in u and bool(re.search(r"/spam\d+/page(?![A-Za-z0-9_.%-])|x.*y", u))
        assert (rows[i].verdict == "block") == hit and rows[i].n_run <= 4
    assert rows[len(urls) - 4].rule == "q.com/"
    assert url_filter.judge(pages.limit(0), rules[:5]).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, ()).collect()} == {"allow"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def brute_pii(text):
    t = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [("card", m.start(), m.end())] * (13 <= len(d) <= 19 and luhn(d))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii(spark):
    rng = random.Random(2)
    parts = ["a.b", "@", "x", "mail.com", ".", "-", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "+49", "(", ")", " ", " ", "é", "🙂", "1.2.3.4.5", "a@b.c.d", "_", "0", "00", "call 555-223-4567", "iban DE89370400440532013000 ", " me [at] foo [dot] com", "+"]
    texts = [None, "", "9" * 20_000, "1." * 5000 + "@b" + ".c" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    docs = table(spark, texts)
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    for i, t in enumerate(texts):
        base = brute_pii(t)
        assert [s for s in found[i] if s[0] in pii.BASE] == base
        assert not [1 for k, s, e in found[i] if k not in pii.BASE and any(a < e and s < b for _, a, b in base)]
    assert sum(k not in pii.BASE for spans in found.values() for k, _, _ in spans) > 20
    row = pii.digest(pii.find_personal_data(docs.where("doc_id = 1"))).first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest() and row.spans == "" and row.n_card == 0
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_poor_labeler():
    rng = random.Random(6)
    counts = Counter()
    for _ in range(4000):
        z = rng.random() < 0.4
        votes = tuple((1 if z else -1) if rng.random() < p else (-1 if z else 1) for p in (0.9, 0.85, 0.5))
        counts["k", votes] += 1
    prior, says, chance = pii.estimate([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert abs(prior["k"] - 0.4) < 0.1
    assert says[0][True][1] > 0.8 and abs(says[2][True][1] - says[2][False][1]) < 0.15


def test_automaton_against_expressions():
    rng = random.Random(9)
    patterns = ["ab+c?", "(x|yz){2,3}", r"[^a-c]\x20*d", "a[0-9]{3}", "zz"]
    found, own = automaton.Automaton(patterns, True), [automaton.Automaton([p], False) for p in patterns]
    for _ in range(500):
        data = "".join(rng.choice("abcxyz d019") for _ in range(rng.randint(0, 30)))
        assert found.seen(data.encode()) == sum(1 << i for i, p in enumerate(patterns) if re.search(p, data))
        for p, a in zip(patterns, own, strict=True):
            m = re.match(p, data)
            assert a.longest(data.encode().translate(a.classes), 0)[0] == (m.end() if m else -1)
            b = automaton.Automaton([p], True, True)
            assert list(b.starts(data.encode().translate(b.classes))) == [bool(re.compile(p).match(data, i)) for i in range(len(data))]


def test_automata_of_many_states(monkeypatch):
    patterns = ["a[ab]{6}c", "b[ab]{5}d", "[ab]{3}e", "zz"]
    whole = automaton.Automaton(patterns, True)
    monkeypatch.setattr(automaton, "MOST_STATES", 140)
    parts = automaton.several(patterns)
    assert len(parts) > 1
    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice("abcdez") for _ in range(rng.randint(0, 40))).encode()
        found = 0
        for a, first in parts:
            found |= a.seen(data) << first
        assert found == whole.seen(data)
    with pytest.raises(ValueError):
        automaton.several(["a[ab]{9}c"])


def test_secret_scan_takes_time_in_proportion():
    began = time.perf_counter()
    for text in ("eyJ" * 400_000, "eyJ.eyJ." * 100_000, "-----BEGIN " * 50_000, "token" * 100_000, "AKIA" * 200_000, "-----BEGIN A B " * 40_000):
        assert secret_scan.scan(text.encode()) is not None
    assert time.perf_counter() - began < 30


def test_secret_scan(spark):
    rng = random.Random(1)
    parts = ["token", "Secret", "PASSWD", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "abc", "é", "x.y=", "AKIAAKIA", "deadbeef", "secret:", "-", "🙂"]
    texts = [None, "", "0" * 50_000, "token=" * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["x ghp_" + "aZ" * 18 + " y", "-----BEGIN RSA PRIVATE KEY-----"]
    rows = {r.doc_id: r.spans for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    base = {r.kind for r in secret_scan.BASE}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in rows[i] if s.kind in base] == secret_scan.brute(t)
    assert [s.kind for i in (-2, -1) for s in rows[len(texts) + i]] == ["git", "pem"]
    d = secret_scan.digest(secret_scan.scan_secrets(table(spark, ["a token=abcdefgh1 b"]))).first()
    assert (d.n_assign, d.spans, d.base_sha256) == (1, "assign:2:17", secret_scan.base_sha256([("assign", 2, 17)]))


def test_vector_topk(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0, 2.0]), (450, [0.5, -3.0]), (451, [1e5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sound = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    expected = []
    for q, v in sound.items():
        if q % 50 == 0:
            best = sorted((-int(v @ x), i) for i, x in sound.items() if i != q and len(x) == len(v))[:5]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    for block in (1024, 2):
        got = vector_topk.top_k(df.repartition(5), df.where("vec_id % 50 = 0"), block=block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert vector_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_scores_of_any_size(spark):
    rows = [(0, [3e5, -2e5]), (1, [1e7, 1e3]), (2, [-4e6, 2.5e6]), (3, [1e6, 3e5]), (50, [8e6, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = vector_topk.top_k(df, df.where("vec_id % 50 = 0")).collect()
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in ints if i != q)
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        huge = spark.createDataFrame([(0, [1e300]), (1, [1e10])], "vec_id long, embedding array<double>")
        vector_topk.top_k(huge, huge).collect()


def test_query_of_several_vectors(spark):
    df = spark.createDataFrame([(0, [0.5, 0.1]), (0, [0.25, 3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vector_topk.top_k(df.repartition(3), df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 768 * 256), (0, 2, 2, 768 * 256), (0, 3, 1, 64 * 256)]


def test_pivots_spare_evaluations(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((20, 16)) * 300
    x = np.floor(centers[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 16)) * 10) / 256
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert vector_topk.evaluated_share(df, df.where("vec_id % 50 = 0")) < 0.3


def test_quality(spark):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        texts.append(words(rng, 30, 300) if not bad else " ".join(f"{w}&&&" for w in words(rng, 30, 300).split()) if i % 8 else "Foo " * 60)
        labels.append((i, 0 if bad else 1, 0))
    texts += [None, "", "x"]
    docs = table(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, may_learn=quality.remainder(F.col("doc_id")) != 1)
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    assert sum((rows[i] >= 0.5) == (i % 4 != 0) for i in held) / len(held) > 0.97
    again = quality.fit(docs.repartition(3), marks.repartition(5), may_learn=quality.remainder(F.col("doc_id")) != 1)
    assert np.allclose(again.weight, model.weight)
    kept = quality.drop_low(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.5 for s in rows.values())
    for marks_ in (marks.limit(0), marks.where("quality = 1")):
        flat = quality.fit(docs, marks_)
        assert {round(r.score, 3) for r in quality.score(docs, flat).collect()} <= {0.5, 1.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_packing(spark, mixed_texts):
    from tokenizers import Tokenizer

    texts = [*mixed_texts, "Don't STOP été 'S 12345 a<|endoftext|>b \x1cq\x85 é ́ ﬁ İ 日本語 🙂"]
    whole = Tokenizer.from_file(queries.tokenizer())
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    rows = packing.pack(table(spark, texts).repartition(5), queries.tokenizer()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sorted(pieces) == list(range(len(texts)))
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(sequences) <= sum(map(len, ids)) / 4096 + 1
    assert packing.pack(table(spark, texts).limit(0), queries.tokenizer()).count() == 0


def test_pack_histogram():
    rng = random.Random(2)
    for _ in range(30):
        counts = Counter(rng.choice([1, 7, 100, 1500, 2048, 4095, 4096, rng.randint(1, 4096)]) for _ in range(rng.randint(1, 800)))
        placed = Counter()
        for sizes, packs in packing.pack_histogram(dict(counts)):
            assert sum(sizes) <= 4096 and packs > 0
            for s in sizes:
                placed[s] += packs
        assert placed == counts
    assert sum(n for _, n in packing.pack_histogram({1: 10**9})) == -(-(10**9) // 4096)


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([5, 1, 5, 2, 5], [5, 2, 5, 1, 5]) in ([(0, 0), (1, 3), (4, 4)], [(0, 0), (3, 1), (4, 4)])
    assert line_dedup.patience([], [1]) == []
    assert line_dedup.removed_lines([1, 2, 3], [7, 2, 3, 8], [9, 6, 6, 9]) == [1, 2]
    assert line_dedup.removed_lines([1, 2, 3], [7, 2, 8, 3], [9, 6, 9, 6]) == []


def brute_removed(a, b, words, least=10):
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[j : j + n]) >= least:
                gone |= set(range(j, j + n))
    return sorted(gone)


def test_removed_lines_of_passages_that_repeat():
    x, y, z, u, v, w = range(6)
    p = [10, 11]
    once, twice = [u, *p, v], [x, *p, y, *p, z]
    assert line_dedup.removed_lines(twice, once, [9, 6, 6, 9]) == [1, 2]
    assert line_dedup.removed_lines(once, twice, [9, 6, 6, 9, 6, 6, 9]) == [1, 2, 4, 5]
    assert line_dedup.removed_lines([x, *p, y, *p, z], [u, *p, v, *p, w], [9, 6, 6, 9, 6, 6, 9]) == [1, 2, 4, 5]
    rng = random.Random(8)
    for _ in range(2000):
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 14))] for k in (5, 7))
        words = [h % 4 * 2 for h in b]
        assert line_dedup.removed_lines(a, b, words) == brute_removed(a, b, words)
    many = [1, 2] * 30_000
    assert line_dedup.removed_lines([*many, 3], [4, *many], [1] * (len(many) + 1)) == list(range(1, len(many) + 1))


def test_removed_lines_of_blocks_in_another_order(spark):
    p, q = ("\n".join(f"{name} line {i} of a block that stands elsewhere in the copy" for i in range(5)) for name in ("First", "Second"))
    assert line_dedup.removed_lines([1, 2, 9, 3, 4], [3, 4, 8, 1, 2], [6] * 5) == [0, 1, 3, 4]
    assert line_dedup.removed_lines([1, 2, 3, 7], [2, 9, 3, 8, 7, 6, 1], [4, 1, 4, 1, 4, 1, 12]) == [6]
    texts = [f"{p}\nA line of its own.\n{q}", f"{q}\nOther words between.\n{p}", f"An opening.\n{q}\n{p}\n{q}"]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    assert [rows[i].text for i in range(3)] == [texts[0], "Other words between.", "An opening."]


def test_line_dedup_of_short_lines(spark):
    """Menus and verse: every line of a run of ten words that any earlier document holds goes, and no other."""
    verse = [f"v{i} of it" if i % 2 else "" for i in range(24)]
    chain = [f"link {i} of four" for i in range(3)]
    menu = [f"dish{i}" for i in range(40)]
    texts = ["\n".join(x) for x in (["own", *verse], ["other", *verse, "end"], chain[:2], chain[1:], chain, ["x", *chain, "y"], menu, ["menu of the day", *menu], ["soup", *menu[:9]], ["a line of ten words and more for all that", "tail"], ["head", "a line of ten words and more for all that", "tail two"], ["a line of ten words and more for all that", "tail two"])]
    rng = random.Random(9)
    texts += ["\n".join(" ".join(["w"] * rng.randint(0, 3)) + rng.choice(["", " a", " b"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts).repartition(3)).collect()}
    assert [rows[i].text for i in (1, 4, 5, 7, 8, 10, 11)] == ["other\nend", texts[4], "x\ny", "menu of the day", texts[8], "head\ntail two", ""]
    lines = [[x.strip() for x in t.split("\n")] for t in texts]
    for j, b in enumerate(lines):
        words = [len(x.split()) for x in b]
        want = {k for a in lines[:j] for k in brute_removed(a, b, words)}
        got = set(rows[j].removed)
        assert got <= want and not any(words[k] for k in want - got)
    hashes = np.array([5, 6, 7, 5, 6, 7, 8], np.int64)
    doc, key = line_dedup.runs(hashes, np.array([4, 0, 6, 4, 0, 6, 9]), np.array([0, 3, 3, 7]))
    assert doc.tolist() == [0, 2, 2] and key[0] == key[1] != key[2]


def test_line_dedup(spark):
    passage = "\n".join(f"This is line {i} of a passage that several documents share" for i in range(5))
    texts = ["An opening of its own with words enough to count as a key.\n" + passage, "Another opening that stands in this one alone, not in others.\nLes.\n" + passage + "\nAnd an end.", "A clean document of a single line with many words in it, alone.\nLes.\n", None, "", passage, "Les.\nx" * 3000]
    docs = table(spark, texts).withColumn("removed", F.lit("clash"))
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[0].text == texts[0] and rows[2].text == texts[2] and rows[3].text is None and rows[4].text == "" and rows[6].text == texts[6]
    assert rows[1].text == "Another opening that stands in this one alone, not in others.\nLes.\nAnd an end." and rows[1].removed == [2, 3, 4, 5, 6]
    assert rows[5].text == "" and (rows[5].n_lines, rows[5].n_removed) == (5, 5)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
