"""The operators against brute force, round trips and held-out labels on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigevents.llm import binary_tokens, decontamination, jaccard, language_id, language_model, main_text, mixing, neighbours, toxicity, url_filter
from sigevents.llm.common import find_words, lower_ascii
from sigevents.llm.components import components
from sigevents.llm.tokens import WordEncoder
from tokenizers import Tokenizer

DOC = "doc_id long, text string, lang string, source string, score double"
NAME = "byte_bpe_50k.json"
TIK = "byte_bpe_50k.tiktoken"


def make(n=160, seed=1):
    r = random.Random(seed)
    vocab = {"en": [a + b for a in ("th", "er", "on", "in") for b in ("ing", "ed", "tion", "s", "er")], "de": [a + b for a in ("sch", "ver", "ge") for b in ("ung", "keit", "lich", "ä", "en")]}
    rows = [(0, None, "en", None, 0.1), (1, "", None, "src1", 0.1), (2, "One two", "en", "src2", None), (3, "one TWO", "en", "x", 0.0), (4, "!!! ...", "de", "src3", 0.0)]
    for i in range(5, n):
        lang = r.choice(["en", "en", "de"])
        text = " ".join(r.choice(vocab[lang]) + r.choice(["", "", ",", "."]) for _ in range(r.choice([8, 40, 150, 600])))
        if i > 20 and r.random() < 0.4:
            _, text, lang, *_ = rows[r.randrange(5, i)]
            words = text.split(" ")
            for _ in range(r.randrange(0, max(1, len(words) // 40) + 1)):
                words[r.randrange(len(words))] = "new"
            text = r.choice([" ", " ", "\n"]).join(words)
        rows.append((i, text, lang, f"src{r.randrange(8)}", 0.5))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


def sets_of(text):
    w = find_words(lower_ascii(text)) if text else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_brute(docs, rows):
    s = {r[0]: sets_of(r[1]) for r in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in ids}
    assert len({c for _, c in got.values()}) < len(ids)


def test_signatures_miss_nothing():
    r, n = np.random.default_rng(1), 0
    for size in (1, 2, 4, 5, 7, 12, 33, 60, 150, 400):
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, size * 2, dtype=np.uint64))[:size]
            b = np.unique(np.concatenate([a[r.random(len(a)) < r.choice([1, 0.95, 0.9, 0.85])], r.integers(0, 2**63, r.integers(0, max(1, size // 4) + 1), dtype=np.uint64)]))
            often = np.sort(a[r.random(len(a)) < r.choice([0, 0.3, 0.9])])
            if len(b) and jaccard.linked(a, b):
                n += 1
                assert np.intersect1d(jaccard.signatures(a, often), jaccard.signatures(b, often)).size
    assert n > 100


def test_long_texts_hash_like_their_parts():
    r = random.Random(5)
    words = [r.choice(["é", "Ab", "x" * 9, "z" * 40_000]) for _ in range(40)] + [f"w{i}" for i in range(30_000)]
    got = jaccard.word_hashes("\n".join(words))
    assert got.tolist() == [int(jaccard.word_hashes(w)[0]) for w in words]


def test_sketches_never_part_linked_sets():
    r = np.random.default_rng(3)
    for size in (1, 6, 50, 146, 3000):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, size // 10 + 1, dtype=np.uint64)]))
            x, y = (np.frombuffer(jaccard.sketch(s), np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_rest_pairs_keep_every_link(spark, monkeypatch):
    """One run of edited copies, no component known: all links stay, however the run is dealt."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(30):
        words = list(base)
        for at in r.sample(range(150), 3):
            words[at] = f"c{i}"
        rows.append((i, " ".join(words)))
    s = {i: jaccard.shingles(t) for i, t in rows}
    node = {jaccard.node_of(x): i for i, x in s.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = spark.createDataFrame(list(node.items()), "node long, doc_id long")
    flat = spark.createDataFrame([(1, len(node), n, len(s[i])) for n, i in node.items()], "run long, n long, node long, size long")
    links = {(a, b) for a in s for b in s if a < b and jaccard.linked(s[a], s[b])}
    for block in (20_000, 7):
        monkeypatch.setattr(jaccard, "RUN_BLOCK", block)
        pairs = jaccard.rest_pairs(docs, names, flat, spark.createDataFrame([], "node long, component long"))
        got = {tuple(sorted((node[x.a], node[x.b]))) for x in pairs.collect()}
        monkeypatch.undo()
        assert links and links <= got and len(got) < 435
    assert jaccard.star_pairs(flat).count() == 29


def test_long_words_that_polynomials_confuse():
    """Two Thue-Morse words, whose difference is zero in any polynomial modulo a power of two."""
    x = "a"
    for _ in range(11):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    assert jaccard.word_hashes(x)[0] != jaccard.word_hashes(y)[0] and jaccard.word_hashes(x)[0] == jaccard.word_hashes(x.upper())[0]


def test_subsets_of_parts_are_enumerated():
    k, n1, n2, k2 = jaccard.plan(40, 0)
    assert (n2, k2) == (3, 1) and n1 * (k2 + 1) > k
    a = np.sort(np.random.default_rng(5).integers(0, 2**63, 40, dtype=np.uint64))
    some, every, spoil, k = jaccard._cut(a, jaccard.mix(a, 2), 1, 40, 0, 80)
    assert len(every) == 3 * n1 and len(some) <= len(every) and spoil > 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150)] + [(-5, 7000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[200] == got[150] == 100 and got[7000] == -5
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_brute(spark, docs, rows):
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 100)
    items = [(1, " ".join(long.split()[20:45])), (2, "one two"), (3, None), (4, "never ever seen in any of these texts at all today"), (10, long[:400])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = [(i, w) for i, t in items for w in decontamination.windows_of(decontamination.item_words(t), 10)]
    expected = {}
    for doc_id, text, *_ in rows:
        w = decontamination.item_words(text)
        hit, found = set(), set()
        for i, x in wins:
            for b in range(len(w) - len(x) + 1):
                if tuple(w[b : b + len(x)]) == x:
                    hit.update(range(b, b + len(x)))
                    found.add(i)
        expected[doc_id] = (len(w), len(hit), sorted(map(str, found)))
    for limit in (1_000_000, 10):  # in one block and in several
        got = {r.doc_id: (r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in decontamination.contamination(docs, bench, block_windows=limit).collect()}
        assert got == expected
    assert expected[2][1] == 2
    assert {r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}


def test_word_encoder_learns_a_word_once_whatever_follows_it():
    """Words are remembered, not pieces with their punctuation, so that the memory holds more and less is encoded again."""
    enc, seen = WordEncoder(NAME, 200), []

    class Counting:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **how):
            seen.append(sum(map(len, texts)))
            return self.tok.encode_batch_fast(texts, **how)

        def encode(self, *args, **how):
            return self.tok.encode(*args, **how)

    plain, enc.tok = enc.tok, Counting(enc.tok)
    words = ["w" + "".join(chr(97 + (i * k) % 26) for k in (1, 3, 7)) + "äu"[i % 2] * (i // 26 + 1) for i in range(120)]
    for mark in (".", ",", "!", "\nund"):
        text = " ".join(w + mark for w in words)
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(seen) < 2 * len(" ".join(words))


def test_tokens_are_exact():
    """Ids are those of the library's plain call, added tokens' strings included."""
    enc, plain, r = WordEncoder(NAME, 500), Tokenizer.from_file(public_tokenizers.path(NAME)), random.Random(1)
    parts = ["a", "B", "é", " ", " ", "\n", "\t", "'s", "'", "1", "!", "%", "..", "日本", " ", "​", "<|endoftext|>", "-", "\r", "  ", "Word,"]
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(4000)] + [None, "ab <|endoftext|> cd"]
    for b in range(0, len(texts), 500):
        flat, n = enc.encode(pa.array(texts[b : b + 500], pa.string()))
        got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts[b : b + 500]]
    assert got[-1] == [397, 220, 50256, 22927]
    assert enc.encode(pa.array([], pa.string()))[0].size == 0


def test_token_file_round_trip(spark, docs, rows):
    plain, start, expected = Tokenizer.from_file(public_tokenizers.path(NAME)), 0, []
    more = [(7, "again"), (7, "again"), (None, "no id"), (10_000, "long " * 200_000), (10_001, "<|endoftext|>")]
    for doc_id, text in sorted([r[:2] for r in rows] + more, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        expected.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    table = docs.select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("shard")).union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'x'", "1"))
    for planes in ({}, {"chunk_ids": 100}):
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_tokens.token_table(table, **planes).collect())
        assert [(d, *x) for x, d in ((g[:1] + g[2:], g[1]) for g in got)] == expected
    assert binary_tokens.token_table(docs.limit(0)).count() == 0
    ids = [np.random.default_rng(k).integers(0, 2**32, k * 37, dtype=np.uint64).astype("<u4") for k in range(6)]
    for planes in ("byte", "bit"):
        names, lengths, flat = binary_tokens.unpack_chunk(binary_tokens.pack_chunk([5, None, 7, 8, 9, 10], np.array(list(map(len, ids))), np.concatenate(ids), 64, planes))
        assert names == [5, None, 7, 8, 9, 10] and flat.tolist() == np.concatenate(ids).tolist() and lengths.tolist() == list(map(len, ids))


def test_language(docs):
    got = {r.doc_id: r for r in language_id.language_table(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[4].lang_pred == "und" and got[0].rejected
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for i, r in got.items() if r.held_out and i > 4]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.language_table(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    r = random.Random(4)
    bad, rows, marks = ["blarg", "zounds", "grumph"], [], []
    for i in range(400):
        words = ["".join(r.choices("aeioulnrst", k=5)) for _ in range(60)]
        if toxic := r.random() < 0.3:
            words[3] = r.choice(bad)
            words[9] = r.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "what a bl4rg and z0unds"), (1003, "blаrg zounds grumph")]  # digits; a Cyrillic letter
    got = {x.doc_id: x for x in toxicity.toxicity_table(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[1002].predicted == got[1003].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    assert toxicity.fold("$$$ 50 idi0t 1diot") == "$$$ 50 idiot idiot"
    auto = toxicity.automaton({"weights": {"trash": 3.0}, "exceptions": ["trash can"]})
    assert toxicity.strength("a trash can", auto) == 0 and toxicity.strength("trash", auto) == 3 and toxicity.strength("trashy", auto) == 0


def test_mixing(docs):
    rows = mixing.leaf_columns(docs)
    total = rows.agg(F.sum("n_tokens")).first()[0]
    got = mixing.mixture_table(docs, budget_share=0.5, max_epochs=2).toPandas()
    longest = rows.agg(F.max("n_tokens")).first()[0]
    leaves = len(got[["domain", "lang", "source"]].drop_duplicates())
    assert 0.5 * total - leaves <= got.n_tokens.sum() <= 0.5 * total + leaves * longest
    assert got.groupby("doc_id").epoch.max().max() <= 1 and not got.duplicated(["doc_id", "epoch"]).any()
    same = mixing.mixture_table(docs.repartition(5), budget_share=0.5, max_epochs=2).toPandas()
    assert sorted(zip(got.doc_id, got.epoch)) == sorted(zip(same.doc_id, same.epoch))
    assert mixing.mixture_table(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns
    # a short source leaves its share to its sibling, not to the other language
    spark = docs.sparkSession
    tree = spark.createDataFrame([("d", "x", "s1", 10), ("d", "x", "s2", 1000), ("d", "y", "s3", 1000)], "domain string, lang string, source string, tokens long")
    share = {r.source: r.share for r in mixing.budgets(tree, 0.5, 1, {"lang": {"x": 1.0, "y": 1.0}}, 1.0).collect()}
    assert share == {"s1": 10, "s2": 492, "s3": 502}


def test_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 16))
    x[50:90] = x[40]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0])]
    got = defaultdict(list)
    for q in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20, min_shards=3).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    assert set(got) == set(range(0, 700, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        best = [int(i) for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        hit += len({i for i, _ in found} & set(best))
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in found)
    assert hit / (20 * len(got)) > 0.9
    assert [i for i, _ in got[60]][:3] == [40, 50, 51] or got[60][0][1] > x[60] @ x[40]


def test_main_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n two<br>three <b>x</b>y</p><aside>No</aside></article><footer>&copy; me</footer></body></html>"
    plain = lambda t: f"<body><p>Template line</p><p>{t}</p><p>Same end</p></body>"
    rows = [(1, "http://h.com/a", page), (2, "http://x.com/p/1", plain("first")), (3, "http://x.com/p/2", plain("second")), (4, None, None), (5, "http://y.com/", ""), (6, "http://h.com/b", page)]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1][0] == "A & B\n\nOne two three xy" == got[6][0] and got[4] == got[5] == ("", 0)
    assert got[2] in (("first", 5), ("Template line\n\nfirst\n\nSame end", 31)) and len(got) == 6

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(3)
    for _ in range(200):
        a, b = (r.choices("abcde", k=r.randrange(12)) for _ in range(2))
        shared = main_text.common_lines(a, b)
        assert len(shared) == lcs(a, b) and lcs([a[i] for i in sorted(shared)], b) == len(shared)


def test_main_text_pairs_across_partitions(spark):
    """Pages without article are compared with their neighbour wherever partitions end; hints around an article do not hide it."""
    page = lambda k: f"<body><p>Group {k // 2} line</p><p>Top</p><p>text {k}</p><p>End</p></body>"
    rows = [(k, f"http://x.com/{k // 2}/{k}", page(k)) for k in range(30)] + [(100, "http://y.com/", page(0)), (None, None, page(0))]
    rows.append((200, "http://z.com/", "<body class='no-sidebar'><div class='layout-with-header social'><article><p>Kept</p><div class='share'>Share</div></article></div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "4", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
            assert len(got) == len(rows)
            assert {k: got[k] for k in range(30)} == {k: f"text {k}" for k in range(30)}
            assert got[100] == got[None] == "Group 0 line\n\nTop\n\ntext 0\n\nEnd" and got[200] == "Kept"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "http://a.example.com/en/", "http://b.com/x", "https://q.net/es/1", "https://cheappills.example.org/a", "https://thther.example.org/en/1", None, "no scheme", "http://b.com", "http://notexample.com/en/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4][:3] == ("cheappills.example.org", "/a", None) and got[5][:3] == ("thther.example.org", "/en/1", None)
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:3] == ("b.com", "", None) and got[9][2] == "com/"
    assert url_filter.segment("cheappills", {"cheap": 5.0, "pills": 5.0, "cheapp": 9.0}) == ["cheap", "pills"]


def test_language_model(docs, rows):
    tokens = {r[0]: [*(find_words(lower_ascii(r[1])) if r[1] else []), "\n"] for r in rows}
    seen = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(seen.values()), len(seen)
    scores = []
    for top in (200_000, 5):  # all counts broadcast, or most of them joined
        got = language_model.score_documents(docs, top_words=top, steps=3, one_in=2).collect()
        assert len(got) == len(rows)
        scores.append({r.doc_id: r.score for r in got})
        for r in got:
            t = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(seen[w] > 0 for w in t), n)
            assert r.base_score == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in t))
            assert np.isfinite(r.score) and r.score < 0
    assert scores[0] == pytest.approx(scores[1], rel=1e-4)  # whatever is broadcast


def trained(texts, steep=False):
    enc = language_model.encoding(TIK)
    ids = [enc.encode_to_numpy(t.lower(), disallowed_special=()).astype("<u2") for t in texts]
    counts = np.bincount(np.concatenate([*ids, np.zeros(0, int)]).astype(int), minlength=1 << 16).astype(float)
    own, inside = language_model.own_ids(counts)
    pairs = np.zeros((language_model.IDS,) * 2)
    for x in ids:
        t = np.append(own[x], language_model.END)
        np.add.at(pairs, (np.r_[language_model.END, t[:-1]], t), 1)
    net = language_model.Attention()
    language_model.start_from(net, pairs)
    net.ready().steep |= steep
    return ids, counts, pairs, {"net": net, "own": own, "inside": inside}


def test_score_is_a_plain_forward_pass_over_each_id():
    """Every id once, from the window with the most context; groups and members are a distribution."""
    texts = ["Hello there, " + "the other one and the " * 30, "", "a", "one two three " * 9]
    for steep in (False, True):
        ids, _, _, m = trained(texts, steep)
        net, own = m["net"], m["own"]
        w = {k: v.astype(float) for k, v in net.w.items()}

        def log_probabilities(context, w=w, net=net):
            x = w["E"][context] + w["P"][: len(context)]
            q, k, v = x @ w["Q"], x @ w["K"], x @ w["V"]
            a = np.exp((q[-1] @ k.T) / language_model.WIDTH**0.5)
            y = x[-1] + (a / a.sum()) @ v @ w["O"]
            g = y @ w["U"] + w["b"]
            g -= np.log(np.exp(g).sum())
            inner = np.einsum("w,gwm->gm", y, w["Ug"]) + w["bg"]
            inner -= np.log(np.exp(inner).sum(1, keepdims=True))
            return g[net.group] + inner[net.group, net.member]

        expected = []
        for x in ids:
            t = np.append(own[x], language_model.END)
            given, total = np.r_[language_model.END, t[:-1]], 0.0
            for i in range(len(t)):
                first = 0 if i < language_model.WINDOW else (1 + (i - language_model.WINDOW) // language_model.STRIDE) * language_model.STRIDE
                p = log_probabilities(given[first : i + 1])
                assert np.exp(p).sum() == pytest.approx(1)
                total += p[t[i]] / np.log(10)
            expected.append(total + m["inside"][x].sum())
        assert language_model.score_ids([x.tobytes() for x in ids], m, 3) == pytest.approx(expected, rel=1e-4)


def test_counts_hold_all_texts(spark, docs, rows):
    texts = [r[1] or "" for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    ids, counts, pairs, m = trained(texts)
    got = language_model.encoded(docs.withColumn("_row", F.monotonically_increasing_id()), ~language_model.held_out(), TIK)
    assert got.count() == len(rows)
    learned = got.where("learn")
    assert (language_model.id_counts(learned) == counts).all()
    assert (language_model.pair_counts(learned, m["own"]) == pairs).all()


def test_training_takes_from_all_of_each_text(spark):
    texts = [" ".join(f"w{i % 90}" for i in range(3000)), "one two", "", "one two"]
    ids, _, _, m = trained(texts)
    table = spark.createDataFrame([(x.tobytes(),) for x in ids], "ids binary").repartition(2)
    rows = language_model.training_windows(table, m["own"], 7, 1).collect()
    given, target = language_model.unpacked(b"".join(bytes(r.windows) for r in rows))
    own = [m["own"][x] for x in ids]
    pairs = Counter(p for x in own for p in zip([language_model.END, *x.tolist()], [*x.tolist(), language_model.END]))
    assert Counter(zip(given[target >= 0].tolist(), target[target >= 0].tolist())) == pairs  # all, with one in one
    assert {r.step for r in rows} == set(range(7))
    some = language_model.training_windows(table, m["own"], 3, 4).count()
    assert 0.15 < some / len(rows) < 0.35
    net = m["net"]
    sums = [language_model.summed_gradient(spark.createDataFrame(rows).repartition(k), net) for k in (1, 3)]
    assert sums[0][1] == sums[1][1] == sum(map(len, ids)) + len(texts)
    for k in net.w:  # whatever the number of tasks
        assert np.allclose(sums[0][0][k], sums[1][0][k], atol=1e-2, rtol=1e-4)

    def loss(name, at, by):
        kept = net.w[name].copy()
        net.w[name].flat[at] += by
        out = net.ready().log10(given, np.maximum(target, 0), target >= 0).astype(float).sum() * -np.log(10)
        net.w[name] = kept
        return out

    for name in net.w:
        at = int(np.abs(sums[0][0][name]).argmax())
        assert (loss(name, at, 1e-2) - loss(name, at, -1e-2)) / 2e-2 == pytest.approx(sums[0][0][name].flat[at], rel=0.05)


def test_equal_pieces_are_encoded_once():
    """Ids are those of each whole text, whatever white space is in it; what repeats costs no more encoding."""
    enc = language_model.encoding(TIK)
    texts = ["", " ", "a", " a", "a ", "a  b", "don't stop 's", "x\n\ny z", "\u3000 a b", "a\u00a0 b c", "é e\u0301 z", "a\x1c b", "\n", "a\tb c\t d", '12 345 a1b2 ,.! "q" ', "日本 語 x", "the words of it " * 500 + "end"]
    coder, given = language_model.PieceEncoder(enc), []
    plain = coder._ids
    coder._ids = lambda t: given.append(t) or plain(t)
    ids, size = coder.encode(pa.array(texts))
    each = [enc.encode_to_numpy(t, disallowed_special=()) for t in texts]
    assert size.tolist() == [len(x) for x in each] and (ids == np.concatenate(each)).all()
    assert sum(map(len, given)) < 500 < sum(map(len, texts))
    assert [len(x) for x in coder.encode(pa.array([""] * 2))] == [0, 2]


def test_words_are_split_at_ascii_white_space_alone():
    texts = [*(f"A{chr(i)}b" for i in range(400)), None, "", "  A\u00a0B \x0b c\n", "\u0130\u212a X"]
    got = [[w for w in x if w] for x in language_model.split_words(pa.array(texts, pa.string())).to_pylist()]
    assert got == [find_words(lower_ascii(t or "")) for t in texts]


def test_windows_of_a_part_are_one_row_and_small_scores_need_no_maximum(spark):
    texts = [" ".join(f"w{i % 90}" for i in range(3000)), "one two", "", "one two"]
    ids, _, _, m = trained(texts)
    assert not m["net"].steep  # by the largest scores that ids can have; norms alone give a larger bound
    table = spark.createDataFrame([(x.tobytes(),) for x in ids], "ids binary").repartition(2)
    one, many = (language_model.training_windows(table, m["own"], 7, 1, *parts).collect() for parts in ((), (3,)))
    cells = [Counter((r.step, r.part % 3, bytes(r.windows[i : i + 66])) for r in rows for i in range(0, len(r.windows), 66)) for rows in (one, many)]
    assert cells[0] == cells[1] and len(many) <= 2 * 7 * 3 < len(one)
    given, target = language_model.unpacked(b"".join(bytes(r.windows) for r in one))
    grads, logs = [], []
    for steep in (False, True):
        m["net"].steep = steep
        grads.append(m["net"].gradient(given, target)[0])
        logs.append(m["net"].log10(given, np.maximum(target, 0), target >= 0))
    assert np.allclose(*logs, atol=1e-5)
    for k, g in grads[0].items():
        assert np.allclose(g, grads[1][k], atol=1e-4 * np.abs(g).max())
    late = (target >= 0) & (np.arange(32) >= 8)
    assert np.allclose(*(m["net"].log10(given, np.maximum(target, 0), late, skip) for skip in (0, 8)), atol=1e-5)


def test_urls_use_all_counts(spark):
    """Scores are the same however few words and tokens are broadcast; runs of letters are cut nowhere."""
    r = random.Random(6)
    words = ["".join(r.choices("bcdfgklmnprtv", k=6)) for _ in range(40)]
    urls = [f"http://{''.join(r.choices(words, k=3))}{r.choice(['', 'casino'])}.org/{r.choice(words)}/{r.choice(words)}" for _ in range(300)]
    urls += [f"http://{'qj' * 120}casino.org/x", None] + [f"http://{r.choice(words)}.net/{r.choice(['es', 'fr'])}/{r.choice(words)}" for _ in range(40)] + [f"http://{r.choice(words)}.com/{r.choice(words)}" for _ in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = [{x.page_id: (x.verdict, x.score) for x in url_filter.judge(pages, **bounds).collect()} for bounds in ({}, {"max_tokens": 3}, {"max_words": 2}, {"max_tokens": 3, "max_words": 2})]
    for other in got[1:]:
        assert {k: v[0] for k, v in other.items()} == {k: v[0] for k, v in got[0].items()}
        assert {k: v[1] for k, v in other.items()} == pytest.approx({k: v[1] for k, v in got[0].items()})
    assert len(got[0]) == len(urls) and got[0][300][1] > got[0][301][1]


def test_windows_score_each_id_once():
    lengths = np.array([1, 5, 31, 32, 33, 56, 57, 100])
    seq, first, skip = language_model.windows(lengths)
    place = np.arange(language_model.WINDOW)
    scored = (place >= skip[:, None]) & (first[:, None] + place < lengths[seq][:, None])
    times = Counter((s, f + p) for s, f, row in zip(seq, first, scored) for p in place[row])
    assert set(times.values()) == {1} and len(times) == lengths.sum()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in make(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[30][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids and 0 not in ids and 1 not in ids and 30 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids


def test_stages_decide_by_row(spark, tmp_path):
    """Rows that repeat, ids of several texts, and rows without id: each row has its own verdict."""
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(150)) for k in "abcdef"}
    near = lambda k: text[k].replace(f"{k}77", "new")
    rows = [(1, text["a"]), (1, text["a"]), (2, text["b"]), (3, near("b")), (3, text["c"]), (None, text["d"]), (None, near("d")), (None, text["a"]), (5, text["e"]), (5, text["f"]), (None, text["e"]), (6, None), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, text["e"][:200]), (2, text["d"][-200:]), (3, "f1 f2 f3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for given in (docs, docs.where("true").repartition(2)):  # a table of files, and another
        kept = count(corpus_pipeline.one_of_each(spark, given, str(tmp_path)))
        d = {k for k in kept if k[0] is None}
        assert len(d) == 1 and d <= {(None, text["d"]), (None, near("d"))}
        assert kept - Counter(d) == Counter({(1, text["a"]): 1, (2, text["b"]): 1, (3, text["c"]): 1, (5, text["e"]): 1, (5, text["f"]): 1, (6, None): 2})
        clean = count(corpus_pipeline.no_benchmark_text(spark, given, str(tmp_path)))
        assert clean == Counter(r for r in rows if r[1] is None or r[1][0] not in "def")
    benchmark = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    reports = [sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in decontamination.contamination(docs, benchmark, block_windows=limit).collect()) for limit in (1_000_000, 1)]
    assert reports[0] == reports[1] and len(reports[0]) == len(rows)
    found = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert found == Counter({(1, 1): 2, (None, 1): 1, (2, 2): 1, (3, 2): 1, (3, 3): 1, (None, None): 2, (5, 5): 2, (None, 5): 1, (6, 6): 2})
