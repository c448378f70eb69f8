"""Operators without SQL against brute force, round trips or held-out labels."""

from __future__ import annotations

import ipaddress
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querygrove.llm import language, mixing, neardup, neighbours, packing, private, quality, toxicity
from querygrove.llm import textkernels as K
from querygrove.operators import components

from ..conftest import DATA

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_groups(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(rng, n_groups=12, size=25):
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t).title() if rng.random() < 0.3 else " ".join(t))
    return list(enumerate(out))


@pytest.mark.parametrize("p", [neardup.CONTRACT, neardup.Params(), neardup.Params(words=3, percent=85, rows=5, bands=21, chunk_docs=4, star_docs=3), neardup.Params(words=3, percent=85, rows=1, bands=21, chunk_docs=3)])
def test_groups_by_brute_force(spark, p):
    docs = copies(random.Random(p.chunk_docs + p.words))
    got = neardup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), p)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_groups(docs, p.words, p.percent)


def test_groups_by_brute_force_on_one_large_block(spark):
    """10,000 near copies of one text, three variants of it that link with few of them, and repeated ids."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    docs = []
    for i in range(10_000):
        t = list(base)
        t[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(t)))
    for k in range(40):  # further and further from the base
        t = list(base)
        for j in range(k // 2):
            t[j] = f"y{k}_{j}"
        docs.append((20_000 + k, " ".join(t)))
    docs += [(30_000, " ".join(base[30:])), (30_000, "quite another text"), (30_001, "quite another text"), (30_002, " ".join(base[30:]) + " end")]
    got = {}
    for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), neardup.CONTRACT).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in got.values())
    sets = [(i, shingle_set(t, 3)) for i, t in docs]
    link = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    near = [(i, s) for i, s in sets if i >= 20_000]
    up = {i: i for i, _ in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def tie(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)

    tail = sets[10_000:]
    for i, s in sets[:10_000]:
        for j, t in [sets[0], *tail] if find(i) == i else tail:
            if i != j and find(i) != find(j) and link(s, t):
                tie(i, j)
    first = sets[:10_000]
    loose = [x for x in first if find(x[0]) != find(0)]
    for i, s in loose:
        for j, t in first:
            if find(i) != find(j) and link(s, t):
                tie(i, j)
    for (i, s), (j, t) in itertools.combinations(near, 2):
        if i != j and find(i) != find(j) and link(s, t):
            tie(i, j)
    assert {i: v.pop() for i, v in got.items()} == {i: find(i) for i in up}


def test_signature_estimates(spark):
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.85):
        got = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(200 * share)).astype(np.uint64)
            rest = rng.integers(0, 2**63, (2, (200 - len(both)) // 2)).astype(np.uint64)
            sets = [np.unique(np.concatenate([both, r])) for r in rest]
            sig = neardup.super_minhash(np.concatenate(sets), np.array([len(s) for s in sets]), 100)
            got.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(got) - share) < 0.02
    one = neardup.super_minhash(np.array([5], np.uint64), np.array([1]), 100)
    assert (one < np.uint64(100) << np.uint64(48)).all() and len(np.unique(one >> np.uint64(48))) == 100


def test_kernels_by_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB \t\n\r\x0b\x0c\x1cé日.#") for _ in range(rng.randint(0, 60))) if rng.random() > 0.1 else None for _ in range(200)]
    got = quality.base_counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        hit = {j + d for j, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(int(got[k][i]) for k in quality.COUNTS) == want
    a = pa.array(texts, pa.string())
    assert sum(len(x) for x in K.slices(a, 50)) == len(texts)
    parts = [quality.base_counts(x) for x in K.slices(a, 50)]
    assert all((np.concatenate([p[k] for p in parts]) == got[k]).all() for k in quality.COUNTS)


def test_rule_counts_by_brute_force():
    rng = random.Random(4)
    bits = ["- a", "* b", "• c", "d...", "e…", "the", "The", "of", "THE,", "word", "\n", "\n\n", " \t", "-", "...", "é!", "A!!", "und", "zz zz"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 30))) if rng.random() > 0.1 else None for _ in range(300)]
    a = pa.array(texts, pa.string())
    got = quality.line_counts(a) | quality.function_counts(a) | quality.pair_counts(a) | quality.letter_counts(a) | quality.mark_counts(a)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in t.split("\n")]
        lines = [x for x in lines if x]
        pairs = list(itertools.pairwise(w))
        want = {
            "n_lines": len(lines), "n_bullets": sum(x[0][0] in "-*•" for x in lines), "n_ellipses": sum(x[-1].endswith(("...", "…")) for x in lines),
            "n_function": sum(x.lower() in quality.FUNCTION_WORDS for x in w), "n_top_pair": max((pairs.count(p) for p in pairs), default=0),
            "n_letters": sum(c.isascii() and c.isalpha() or not c.isascii() for c in t), "n_upper": sum("A" <= c <= "Z" for c in t), "n_marks": t.count("!"),
        }
        assert {k: int(v[i]) for k, v in got.items()} == want


CASCADE = ["a b c " * 30, "The A!! of B!! " * 30, "the word of it " * 3 + " ".join(f"w{i}" for i in range(90)), "x" * 900, " ".join(f"v{i}" for i in range(90)), "the of " + " ".join(f"#{i} %" for i in range(90)), None]


def test_cascade_order_changes_no_verdict():
    texts = pa.array(CASCADE, pa.string())
    rng = random.Random(2)
    orders = [rng.sample(quality.RULES, len(quality.RULES)) for _ in range(40)]
    assert len({tuple(quality.verdicts(texts, o)[2]) for o in orders}) == 1
    assert quality.verdicts(texts, quality.RULES)[2].tolist() == [False, False, True, False, False, False, False]


def test_cascade_gives_each_rule_what_is_left(monkeypatch):
    """A rule is given, and its counts are taken of, the texts that all rules before it passed."""
    texts = pa.array(CASCADE, pa.string())
    rules = {r.name: r for r in quality.RULES}
    order = [rules["symbols"], rules["function_words"], rules["top_pair"], rules["marks"]]
    counted: dict[str, int] = {}
    for name, f in list(quality.MEASURES.items()):
        monkeypatch.setitem(quality.MEASURES, name, lambda t, f=f, name=name: (counted.__setitem__(name, counted.get(name, 0) + len(t)), f(t))[1])
    tally: dict[str, int] = {}
    quality.verdicts(texts, order, tally)
    alive = int((~quality.verdicts(texts, order)[1]).sum())
    assert alive == 3 and tally == {"symbols": 3, "function_words": 2, "top_pair": 1, "marks": 1}
    assert counted == {"n_function": 4, "n_top_pair": 2, "n_marks": 2}  # two runs


def test_rules_are_ordered_by_rejection_per_cost(spark):
    measured = {"symbols": (9, 1, 1.0), "shouting": (9, 4, 1.0), "marks": (9, 4, 8.0), "bullets": (9, 0, 3.0), "ellipses": (9, 0, 2.0)}
    some = [r for r in quality.RULES if r.name in measured]
    assert [r.name for r in quality.order_rules(measured, some)] == ["shouting", "symbols", "marks", "ellipses", "bullets"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = quality.measure(docs, quality.RULES, 10**6)
    assert set(got) == {r.name for r in quality.RULES} and all(s > 0 for *_, s in got.values())
    c, failed, _ = quality.verdicts(pa.array([r[0] for r in docs.select("text").collect()], pa.string()), ())
    assert {n for n, *_ in got.values()} == {int((~failed).sum())}
    free = 10 * c["n_symbols"] > 3 * c["n_words"]
    assert got["symbols"][1] == int((free & ~failed).sum())


def test_components_by_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(70)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_components_of_a_hub(spark):
    """A star far above the bound for hubs, chained to others; and no answer short of convergence."""
    edges = [(5, 1000 + i) for i in range(3000)] + [(1000 + i, 9000 - i) for i in range(3)] + [(9000, 1), (8000, 8001)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert {v for k, v in got.items() if k not in (8000, 8001)} == {1} and got[8001] == 8000 and len(got) == 3007
    with pytest.raises(RuntimeError):
        components.connected_components(df, most_rounds=1)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = packing.pack_documents(docs, group_docs=64).toPandas()
    whole = plain_tokenizer()
    for i, text in docs.collect():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], np.uint32)
        mine = got[got.doc_id == i].sort_values("start")
        assert mine["length"].sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
    fill = got.groupby("sequence_id")["length"].sum()
    padded = fill.where((fill & (fill - 1)) == 0, 2048)
    assert fill.max() <= 2048 and fill.sum() / padded.sum() > 0.99
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()


def plain_tokenizer():
    """The tokenizer of the contract: read from its file, with nothing set on it."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_tokenizers_agree():
    fast, whole = packing.tokenizer(), plain_tokenizer()
    rng = random.Random(1)
    texts = ["", "a" * 100_000, " " * 5000, "\n\n \t\r\n x", "don't I'LL we've 12 345", "日本語 ελληνικά русский \U0001f600\u200d\U0001f525", "a\u00a0b\u2003c\u3000d"]
    texts += ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n", "<|endoftext|", "<|ENDOFTEXT|> <|startoftext|>", "x" * 3000 + "<|endoftext|>"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x3000, 0x3100)])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert fast(t) == whole.encode(t, add_special_tokens=False).ids
    assert fast("a<|endoftext|>b")[1] == 50256


def test_packing_special_tokens_and_copies(spark):
    """Ids, sizes and crcs with the file's own tokens in the texts; copies of one row don't share a group."""
    docs = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>" * 3000), (3, None)] + [(None, "same text <|endoftext|>")] * 400
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), group_docs=20).toPandas()
    whole = plain_tokenizer()
    for i, text in docs[:3]:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        mine = got[got.doc_id == i].sort_values("start")
        assert mine["length"].sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes()) for r in mine.itertuples())
    copies = got[got.doc_id.isna()]
    assert copies["length"].sum() == 400 * len([*whole.encode(docs[-1][1], add_special_tokens=False).ids, 1])
    groups = copies.assign(group=copies.sequence_id // (1 << 24)).groupby("group")["start"].apply(lambda s: (s == 0).sum())
    assert len(groups) > 10 and groups.max() < 60


def test_first_fit_by_brute_force():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    room, want = [], []
    for k, s in enumerate(sizes):
        b = next((i for i, r in enumerate(room) if r >= s), None)
        if b is None:
            room.append(100)
            want.append([])
            b = len(room) - 1
        room[b] -= s
        want[b].append(k)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = language.identify(docs.where(held), language.train(docs.where(~held))).select("lang", "language.lang_pred").collect()
    assert np.mean([a == b for a, b in got]) > 0.97


def plain_grams(text, n):
    import unicodedata

    t = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def plain_kernel(a, b):
    return sum(len(plain_grams(a, n) & plain_grams(b, n)) / np.sqrt(max(len(plain_grams(a, n)), 1) * max(len(plain_grams(b, n)), 1)) for n in (1, 2, 3))


SCRIPTS = {
    "zh": "今天天气很好我们去公园散步他说这本书非常有意思学生们在图书馆里学习历史和文学", "ja": "今日は天気がとても良いので公園へ散歩に行きました彼はこの本が面白いと言った学生は図書館で勉強する",
    "ko": "오늘은 날씨가 매우 좋아서 우리는 공원에 산책하러 갔다 그는 이 책이 재미있다고 말했다 학생들은 도서관에서 공부한다", "ar": "الطقس جميل اليوم ذهبنا إلى الحديقة للتنزه قال إن هذا الكتاب ممتع جدا يدرس الطلاب في المكتبة",
    "fa": "امروز هوا خیلی خوب است ما برای قدم زدن به پارک رفتیم او گفت که این کتاب بسیار جالب است دانشجویان در کتابخانه", "ru": "сегодня очень хорошая погода мы пошли гулять в парк он сказал что эта книга очень интересная студенты учатся",
    "bg": "днес времето е много хубаво отидохме на разходка в парка той каза че тази книга е много интересна студентите учат", "en": "the weather is very good today we went for a walk in the park he said that this book is interesting students",
}


def cut(text, rng, n=14):
    at = rng.randrange(max(1, len(text) - n))
    return text[at : at + n]


def test_scripts_are_told_apart():
    """Languages that share a script with thousands of letters, or an alphabet, and pieces of few letters."""
    rng = random.Random(5)
    rows = [(lang, cut(t, rng)) for lang, t in SCRIPTS.items() for _ in range(40)]
    rng.shuffle(rows)
    m = language.fit([t for _, t in rows], [x for x, _ in rows], landmarks=20)
    held = [(lang, cut(t, rng)) for lang, t in SCRIPTS.items() for _ in range(25)]
    got, score = m.predict([t for _, t in held])
    right = {lang: np.mean([g == x for g, (x, _) in zip(got, held, strict=True) if x == lang]) for lang in SCRIPTS}
    assert all(v >= 0.9 for v in right.values()), right
    one, two = m.kernel(["今天天气很好", "他说这本书"])[0]
    assert not np.allclose(one, two)


@pytest.mark.parametrize("dense", [language.DENSE, 0])
def test_ridge_by_definition(monkeypatch, dense):
    """Kernel values and predictions against kernels over plain sets and a ridge solved plainly."""
    monkeypatch.setattr(language, "DENSE", dense)
    rng = random.Random(9)
    rows = [(lang, cut(SCRIPTS[lang], rng, rng.choice([3, 9, 20]))) for lang in ("zh", "ja", "ru", "bg", "en") for _ in range(12)] + [("en", "a-b, c 12")]
    texts, langs = [t for _, t in rows], [x for x, _ in rows]
    m = language.fit(texts, langs, landmarks=4)
    chosen = [i for lang in sorted(set(langs)) for i in [j for j, x in enumerate(langs) if x == lang][:4]]
    k = np.array([[plain_kernel(a, texts[j]) for j in chosen] for a in texts])
    assert np.allclose(m.kernel(texts)[0], k, atol=1e-5)
    y = np.array([[1.0 if x == lang else -1.0 for lang in sorted(set(langs))] for x in langs])
    alpha = np.linalg.solve(k.T @ k + 1e-3 * len(texts) * k[chosen] + 1e-6 * np.eye(len(chosen)), k.T @ y)
    held = [cut(SCRIPTS[lang], rng, 10) for lang in ("zh", "ja", "ru", "bg", "en") for _ in range(10)]
    s = np.array([[plain_kernel(a, texts[j]) for j in chosen] for a in held]) @ alpha
    p = np.exp(8 * s)
    p /= p.sum(axis=1, keepdims=True)
    got, score = m.predict(held)
    assert got == [sorted(set(langs))[i] for i in s.argmax(axis=1)] and np.allclose(score, p.max(axis=1), atol=2e-3)


def small_network(texts, **kw):
    """A network of random weights over the entries of some texts, but for every third of them."""
    p = toxicity.Params(window=5, stride=2, hidden=3, word_dim=2, char_dim=3, stem_dim=2, attention=2, **kw)
    vocab = {t: np.unique(k)[np.arange(len(np.unique(k))) % 3 > 0] for t, (k, _) in toxicity.Batch(pa.array(texts), p).parts.items()}
    return toxicity.Network(p, {k: v.astype(np.float64) for k, v in toxicity.init(p, vocab).items()}, vocab)


def test_gradient_by_differences():
    texts = ["a bad dog runs away now again", "hi there", "x"]
    net = small_network(texts)
    p, w = net.p, net.w
    b = toxicity.Batch(pa.array(texts), p, net.vocab)
    row, begin = b.windows(p)
    ids, y, weight = b.cut(row, begin, p), np.array([1.0, 0, 1])[row], np.ones(len(row))

    def loss():
        logit, _ = net.forward(net.gates(b.embed(w)), ids)
        return float((np.log1p(np.exp(logit)) - y * logit).sum())

    g = net.gradient(b, b.embed(w), ids, y, weight)
    for k in w:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][i] += 1e-2
        up = loss()
        w[k][i] -= 2e-2
        down = loss()
        w[k][i] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(g[k][i]), rel=0.05, abs=5e-3)


def plain_score(net, text):
    """The score of a text with one loop for each sum: words, entries, windows, gates, attention."""
    p, w = net.p, net.w

    def h(data):
        raw = np.frombuffer(data, np.uint8)
        return int(K.span_hash(raw, np.array([0]), np.array([len(raw)]))[0])

    def mixed(x):
        return int(K.mix(np.array([x & (2**64 - 1)], np.uint64))[0])

    def entry(table, key):
        at = [int(k) for k in net.vocab[table]]
        return w[table][at.index(key) + 1] if key in at else w[table][0]

    def vector(word):
        grams = [word[i : i + n] for n in p.grams for i in range(len(word) - n + 1)] or [word]
        starts = [i == 0 for n in p.grams for i in range(len(word) - n + 1)] or [True]
        stems = [word[:n] for n in p.stems if len(word) >= n] or [word[: p.stems[0]]]
        chars = [entry("char", mixed(h(x) + 977 * s)) for x, s in zip(grams, starts, strict=True)]
        return np.concatenate([entry("word", h(word)), sum(chars) / len(chars), sum(entry("stem", mixed(h(x) + 31337)) for x in stems) / len(stems)])

    sig = lambda x: 1 / (1 + np.exp(-x))
    data = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)))
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    if not words:
        return 0.0
    d, best = p.hidden, -np.inf
    begins = [0]
    while begins[-1] + p.window < len(words):
        begins.append(begins[-1] + p.stride)
    for begin in begins:
        xs = [vector(x) for x in words[begin : begin + p.window]]
        states = [np.zeros(2 * d) for _ in xs]
        for way, order, half in (("f", range(len(xs)), 0), ("b", range(len(xs) - 1, -1, -1), d)):
            s = np.zeros(d)
            for k in order:
                x, g = xs[k] @ w[f"x{way}"] + w[f"b{way}"], s @ w[f"u{way}"]
                z, r = sig(x[:d] + g[:d]), sig(x[d : 2 * d] + g[d : 2 * d])
                new = np.tanh(x[2 * d :] + r * g[2 * d :])
                s = (1 - z) * new + z * s
                states[k][half : half + d] = s
        e = np.exp([np.tanh(s @ w["wa"]) @ w["va"] for s in states])
        best = max(best, float(sum(a * s for a, s in zip(e / e.sum(), states, strict=True)) @ w["out"] + w["bias"][0]))
    return float(sig(best))


def test_scores_by_plain_loops():
    rng = random.Random(7)
    vocab = ["bad", "idiots", "Éa", "x", "12a", "worthless", "日本", "of", "then", "B-c"]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 4, 5, 6, 7, 8, 23)] + ["", " .,", None, "new Words that none has"]
    net = small_network([t or "" for t in texts[:7]])
    got = toxicity.score_texts(net, pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)
    assert got[7] == got[8] == got[9] == 0


def test_windows_cover_the_text():
    p = toxicity.Params(window=7, stride=5)
    for n in (0, 1, 6, 7, 8, 12, 13, 40):  # and no passage of 20 words falls between two windows of the registered settings
        registered = toxicity.Params()
        long = toxicity.Batch(pa.array([" ".join(["w"] * (50 + n))]), registered).windows(registered)[1]
        assert all(any(x <= at and at + 20 <= x + registered.window for x in long) for at in range(50 + n - 20 + 1))
        b = toxicity.Batch(pa.array([" ".join(["w"] * n), "q r"]), p)
        row, begin = b.windows(p)
        seen = {int(x) + j for r, x in zip(row, begin, strict=True) if r == 0 for j in range(p.window)}
        assert set(range(n)) <= seen
    many = toxicity.Batch.of_many(pa.array(["some words here", "and other words", None, "here"]), p)
    one = toxicity.Batch(pa.array(["some words here", "and other words", None, "here"]), p)
    assert (many.key == one.key).all() and (many.ids == one.ids).all() and all((many.parts[t][k] == one.parts[t][k]).all() for t in toxicity.TABLES for k in (0, 1)) and (many.count == one.count).all()


def ranking(score, label):
    """Area under the curve: how often a toxic text scores above a clean one, ties half."""
    a, b = score[label == 1][:, None], score[label == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


def test_toxicity_held_out(spark):
    base = DATA.replace("0.001", "0.1")
    got = toxicity.op3_recurrent_toxicity(spark, base).where("held_out").join(spark.read.parquet(f"{base}/labels.parquet").where("toxic IS NOT NULL"), "doc_id").toPandas()
    hit = got.score >= 0.5
    assert (hit.astype(int) == got.predicted).all()
    assert hit[got.toxic == 1].mean() > 0.85 and hit[got.toxic == 0].mean() < 0.03
    assert ranking(got.score.to_numpy(), got.toxic.to_numpy()) > 0.95


def test_surrogates(spark):
    texts = ["Write to Jo.Doe@Example.org, jo.doe@example.org or x9@b.net.", "Mrs. Anna Karlsson and Mr Otto met Frau Karlsson.", "+1 (201) 555-0173 is +12015550173; 10.0.0.1 and 4111 1111 1111 1111.", 'token = "0123456789abcdef0123456789abcdef01234567"', "nothing here 3.5 2024-01-02"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (private.BROADCAST_ROWS, -1):
        got = {r["doc_id"]: r["private"] for r in private.pseudonymise(df, broadcast_rows=limit).collect()}
        mails = re.findall(r"\S+@\S+\w", got[0]["text"])
        assert len(mails) == 3 and mails[0].lower() == mails[1] != mails[2] and "doe" not in got[0]["text"].lower()
        m = re.match(r"Mrs\. (\w+) (\w+) and Mr (\w+) met Frau (\w+)\.", got[1]["text"])
        assert m and m[2] == m[4] and not {"Anna", "Otto", "Karlsson"} & set(m.groups())
        digits = re.findall(r"\+1 ?\(?\d{3}\)? ?\d{3}-?\d{4}", got[2]["text"])
        assert len({re.sub(r"\D", "", d) for d in digits}) == 1 and "555-0173" not in got[2]["text"]
        card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[2]["text"])[0]
        assert card.startswith("4") and card != "4111 1111 1111 1111" and private.luhn(card.replace(" ", "")) == 0
        assert re.search(r'token = "[0-9a-f]{40}"', got[3]["text"]) and "0123456789abcdef" not in got[3]["text"]
        assert got[4]["text"] == texts[4] and got[4]["n_entities"] == 0


LATIN = private.SYLLABLES["LATIN"][1]


def ends(word, gender):
    return word.lower().endswith(tuple(LATIN[gender]))


def test_surrogates_of_names_numbers_and_addresses(spark):
    texts = [
        "Mrs. Anna Karlsson wrote. Later Anna Karlsson called; Anna and ANNA left, Annabel stayed.", "Dr. Anna Karlsson and Prof. Karlsson", "Mrs. Anna", "Mr. Sasha Berg", "Ms. Sasha Berg",
        "+351 912 345 678 or 912345678 or +351912345678", "(201) 555-0173, 201-555-0173, 2015550173, +1 201 555 0173", "+44 20 7946 0958 and 020 7946 0958",
        "2001:0db8:0000:0000:0000:ff00:0042:8329 is 2001:db8::ff00:42:8329 and 2001:DB8::FF00:42:8329, at 12:30:45, a::b", "1234567890 12345678901 3.1415926535 -1234567890",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for limit in (private.BROADCAST_ROWS, -1):
        got = {r["doc_id"]: r["private"]["text"] for r in private.pseudonymise(df, broadcast_rows=limit).collect()}
        seen.append(got)
        m = re.fullmatch(r"Mrs\. (\w+) (\w+) wrote\. Later (\w+) (\w+) called; (\w+) and ANNA left, Annabel stayed\.", got[0])
        assert m and m[1] == m[3] == m[5] and m[2] == m[4] and "Anna " not in got[0] and ends(m[1], "f")
        assert got[1] == f"Dr. {m[1]} {m[2]} and Prof. {m[2]}" and got[2] == f"Mrs. {m[1]}"
        first, second = got[3].split()[1], got[4].split()[1]
        assert first == second and ends(first, "n") and got[3].split()[2] == got[4].split()[2]
        a, b, c = re.fullmatch(r"\+351 (\d{3} \d{3} \d{3}) or (\d{9}) or \+351(\d{9})", got[5]).groups()
        assert a.replace(" ", "") == c != "912345678" and b == "912345678"  # nine bare digits aren't taken for a number
        numbers = [re.sub(r"\D", "", x)[-10:] for x in got[6].split(", ")]
        assert len(set(numbers)) == 1 and numbers[0] != "2015550173" and got[6].endswith(f"+1 {numbers[0][:3]} {numbers[0][3:6]} {numbers[0][6:]}")
        m = re.fullmatch(r"\+44 (\d\d \d{4} \d{4}) and 0(\d\d \d{4} \d{4})", got[7])
        assert m and m[1] == m[2] != "20 7946 0958"
        m = re.fullmatch(r"(\S+) is (\S+) and (\S+), at 12:30:45, a::b", got[8])
        full = [ipaddress.IPv6Address(x) for x in m.groups()]
        assert len(set(full)) == 1 and full[0] != ipaddress.IPv6Address("2001:db8::ff00:42:8329") and len(m[1]) == 39 and "::" in m[2] and m[3] == m[2].upper()
        parts = got[9].split()
        assert parts[0] != "1234567890" and len(parts[0]) == 10 and parts[1:] == texts[9].split()[1:]
    assert seen[0] == seen[1]


def plain_entities(text):
    """The digital entities of the tables, found plainly: token by token, without the module's patterns."""
    out = set()
    tokens = [(m.start(), m.group()) for m in re.finditer(r"\S+", text)]
    for k, (at, tok) in enumerate(tokens):
        bare = tok.strip('.,;"#%&$*!')
        begin = at + tok.index(bare) if bare else at
        span = (begin, begin + len(bare))
        octets = bare.split(".")
        if "@" in bare and "." in bare.split("@")[1]:
            out.add((*span, "email", bare.lower()))
        elif len(octets) == 4 and all(o.isdigit() and int(o) < 256 for o in octets):
            out.add((*span, "ip", bare))
        elif bare.isdigit() and bare.isascii() and 13 <= len(bare) <= 19:
            out.add((*span, "card", bare))
        elif bare.isdigit() and bare.isascii() and len(bare) == 10:
            out.add((*span, "phone", bare.lstrip("0")))
        elif len(bare) >= 32 and set(bare) <= set("0123456789abcdefABCDEF"):
            out.add((*span, "secret", bare))
        elif bare == "+1" and k + 2 < len(tokens) and re.fullmatch(r"\(\d{3}\)", tokens[k + 1][1]) and re.match(r"\d{3}-\d{4}", tokens[k + 2][1]):
            end = tokens[k + 2][0] + 8
            out.add((at, end, "phone", re.sub(r"\D", "", text[at + 2 : end]).lstrip("0")))
    return out


def shape(text):
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", text)))


def test_surrogates_by_brute_force(spark):
    """The query on a whole table against plain detection: the same places are replaced and nothing
    else, equal entities alike, different ones differently, none by a real one, in the same format."""
    where = DATA.replace("0.001", "0.1")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in private.op7_surrogates(spark, where).collect()}
    assert set(got) == set(docs)
    to, real, n = {}, set(), 0
    for i, text in docs.items():
        found = sorted(plain_entities(text or ""))
        assert got[i]["n_entities"] == len(found), (i, found)
        new, at, back = got[i]["text"], 0, 0
        for s, e, kind, canon in found:
            assert text[at:s] == new[at + back : s + back]
            after = new[s + back : e + back]
            if kind == "ip":  # an octet's length may change
                after = re.match(r"(?:\d+\.){3}\d+", new[s + back :])[0]
                back += len(after) - (e - s)
            elif kind == "secret" and text[s:e].islower():
                assert re.fullmatch(r"[0-9a-f]+", after)
            else:
                assert shape(after) == shape(text[s:e])
            if kind == "phone":
                assert after.startswith("+1 ") == text[s:e].startswith("+1 ")
                value = re.sub(r"\D", "", after.removeprefix("+1"))[-len(canon) :]
            else:
                value = after.lower() if kind == "email" else after
            if kind == "card":
                assert (private.luhn(after) == 0) == (private.luhn(text[s:e]) == 0) and after[0] == text[s]
            assert to.setdefault((kind, canon), value) == value
            real.add((kind, canon))
            at, n = e, n + 1
        assert text is None and new is None or text[at:] == new[at + back :]
    assert n > 300 and len({(k, v) for (k, _), v in to.items()}) == len(to) and not {(k, v) for (k, _), v in to.items()} & real


def test_surrogates_stay_distinct(spark):
    """A space so small that first draws collide: every entity still gets its own."""
    found = spark.createDataFrame([("ssn", f"{i:02d}", "n") for i in range(40)] + [("name", "ann", "f")], "kind string, canon string, gender string")
    again = {(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in private.redrawn(found).collect()}
    assert again.pop(("name", "ann")) == (0, "f")
    new = [private.surrogate(private.KEY, "ssn", f"{i:02d}", again.get(("ssn", f"{i:02d}"), (0,))[0]) for i in range(40)]
    assert again and len(set(new)) == 40 and not set(new) & {f"{i:02d}" for i in range(40)}


def test_mix_is_near_its_targets(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    m = mixing.mix(docs, bin_rows=700).toPandas()
    assert (m.copies <= 2).all() and len(m) == docs.count()
    taken = (m.copies * m["size"]).groupby(m.source).sum()
    target = m.groupby("source").target.first()
    assert (abs(taken - target) <= 0.02 * target + 2 * m["size"].max()).all()
    assert target.sum() == pytest.approx(1.5 * m["size"].sum())


def test_neighbours_recall(spark):
    """The registered settings on a table of some forty leaves a tree, every answer against brute
    force; and what the rounds of NN-descent add to the lists of the first graph."""
    v = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/embeddings.parquet")
    got = neighbours.op9_nn_descent(spark, DATA.replace("0.001", "0.1")).toPandas()
    rows = v.orderBy("vec_id").toPandas()
    x = np.stack(rows.embedding).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = rows.vec_id.to_numpy(), []
    assert len(ids) > 40 * neighbours.Params().leaf
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        hits.append(len(set(best) & set(mine.vec_id)) / 5)
        assert np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)], atol=1e-12) and list(mine["rank"]) == [1, 2, 3, 4, 5]
    assert np.mean(hits) >= 0.95

    nodes = neighbours.nodes_of(neighbours.valid(v).distinct(), 5).cache()
    near = np.argsort(-(x @ x.T - 9 * np.eye(len(x))), axis=1)[:, :5]
    share = {}
    for rounds in (0, 1, None):
        lists = {r["node"]: set(r["nbrs"]) for r in neighbours.build(nodes, neighbours.Params(rounds=rounds)).collect()}
        share[rounds] = np.mean([len({int(ids[j]) for j in near[i]} & lists.get(int(ids[i]), set())) / 5 for i in range(len(ids))])
    nodes.unpersist()
    assert share[0] + 0.1 < share[1] < share[None] and share[None] > 0.95, share


def test_neighbours_shuffles(spark, monkeypatch):
    """A round and a hop shuffle four times at most: on many partitions these take the time. A third of
    the vectors are near copies; answers against brute force, and the same when nothing is broadcast."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[::3] = x[0] + 0.05 * rng.normal(size=x[::3].shape)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    shuffles, write = {"graph": [], "beams": []}, neighbours.materialise

    def counted(df, name):
        shuffles.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, name)

    monkeypatch.setattr(neighbours, "materialise", counted)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neighbours.nearest(v).toPandas()
        assert 0 < max(shuffles["graph"][1:]) <= 4 and 0 < max(shuffles["beams"]) <= 4, shuffles
        monkeypatch.setattr(neighbours, "BROADCAST", 0)
        assert sorted(neighbours.nearest(v).toPandas().itertuples(index=False)) == sorted(got.itertuples(index=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        s = x @ x[q]
        s[q] = -9
        assert list(got[got.query_id == q].sort_values("rank").vec_id) == np.argsort(-s)[:5].tolist()


def test_pipeline_by_brute_force(spark, duck, tmp_path):
    """run() against each stage done plainly."""
    sql = quality.ORACLE
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall()}
    docs = [(i, t, s) for i, t, s in duck.execute("SELECT doc_id, text, source FROM documents").fetchall() if i in kept]
    comp = brute_groups([(i, t) for i, t, _ in docs], 5, 80)
    docs = [(i, t, s) for i, t, s in docs if comp[i][1] == i]
    private_texts = {r["doc_id"]: r["private"]["text"] for r in private.pseudonymise(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")).collect()}
    assert all((private_texts[i] != t) == bool(plain_entities(t)) for i, t, _ in docs)
    docs = [(i, private_texts[i], s) for i, t, s in docs]
    mixed = mixing.mix(spark.createDataFrame([(i, s, len(WORD.findall(t.encode()))) for i, t, s in docs], "doc_id long, source string, size long")).collect()
    copies_of = {r["doc_id"]: r["copies"] for r in mixed}
    whole = plain_tokenizer()
    want = {i: (copies_of[i] * (len(whole.encode(t, add_special_tokens=False).ids) + 1)) for i, t, _ in docs if copies_of[i]}
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048
