"""Language, Jaccard links, decontamination, secrets, quality and token counts against plain Python."""

import collections
import hashlib
import random
import re
import time

import fixtures
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bomrec.llm import decontaminate, jaccard, language, quality, secrets, token_counts
from bomrec.llm.common import shared_dir


def shingles(text, k=5):
    w = fixtures.words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked_groups(some, percent=75):
    sets = [shingles(t) for _, t, *_ in some]
    root = list(range(len(some)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(some)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return sets, [find(x) for x in range(len(some))]


def chains(seed, groups=6, n=12):
    """Groups whose members each change a few words of the one before, so that ends are linked only by chains."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        text = fixtures.prose(rng, rng.choice([12, 30, 60, 200])).split(" ")
        passage = fixtures.prose(random.Random(99), 20)
        for _ in range(n):
            text = list(text)
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            out.append((len(out), " ".join(text) + (f" {passage}" if g % 2 else ""), "en", "s"))
    rng.shuffle(out)
    return out


def near_copies(n=40):
    """One text, each copy with one or two words changed, so that nearly all pairs are links; and another text."""
    rng, out = random.Random(5), []
    base = fixtures.prose(rng, 100).split(" ")
    for i in range(n):
        text = list(base)
        for _ in range(1 + i % 2):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        out.append((i, " ".join(text), "en", "s"))
    return [*out, (n, out[0][1], "en", "s"), (n + 1, fixtures.prose(rng, 50), "en", "s")]


@pytest.mark.parametrize("some", [fixtures.rows(), chains(3), chains(4, 3, 30)], ids=["mixed", "chains", "long chains"])
def test_jaccard_components(spark, some):
    rows, links = jaccard.ngram_jaccard_join(fixtures.table(spark, some, clashing=True))
    sets, group = linked_groups(some)
    least = {}
    for (i, *_), g in zip(some, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = collections.Counter((i, len(s), i if not s else least.get(g)) for (i, *_), s, g in zip(some, sets, group, strict=True))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows.collect()) == want
    for r in links.collect():
        assert 175 * r["shared"] >= 75 * (r["n_a"] + r["n_b"])


@pytest.mark.parametrize("cut", [None, (3, 1 << 18)], ids=["one block", "many blocks"])
@pytest.mark.parametrize("some", [fixtures.rows(), chains(3), near_copies()], ids=["mixed", "chains", "near copies"])
def test_jaccard_links(spark, some, cut, monkeypatch):
    """All links of different texts, also inside a group of near copies, and each row's number of links."""
    if cut:
        monkeypatch.setattr(jaccard, "BLOCK_CLASSES", cut[0])
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", cut[1])
    rows, links = jaccard.ngram_jaccard_join(fixtures.table(spark, some, clashing=True))
    sets = [shingles(t) for _, t, *_ in some]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = collections.Counter((i, sum(linked(s, t) for t in sets) - bool(s)) for (i, *_), s in zip(some, sets, strict=True))
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in rows.collect()) == want
    found = list(jaccard.shingle_sets(pa.array([t for _, t, *_ in some], pa.string()), jaccard.Rule()))
    keys = {jaccard.set_key(f, 1): sets[i] for i, f in found if len(f)}
    pairs = [(a, b, len(keys[a]), len(keys[b]), len(keys[a] & keys[b])) for a in keys for b in keys if a < b and linked(keys[a], keys[b])]
    assert collections.Counter(map(tuple, links.collect())) == collections.Counter(pairs)


def test_jaccard_product():
    draw = np.random.default_rng(2)
    for spread in (40, 400, 40_000):
        sets = [np.unique(draw.integers(0, spread, int(n))).astype(np.uint64) for n in draw.integers(1, 300, 30)]
        for a, b in ((sets, sets), (sets[:11], sets[11:])):
            assert jaccard.product(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_jaccard_of_no_rows(spark):
    rows, links = jaccard.ngram_jaccard_join(fixtures.table(spark, []))
    assert rows.collect() == [] and links.collect() == []


def test_parity_bits_never_overstate_a_difference():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n, m, both = (int(x) for x in draw.integers(1, 400, 3))
        pool = draw.integers(0, 2**63, n + m + both).astype(np.uint64)
        a, b = np.unique(np.concatenate([pool[:both], pool[both : both + n]])), np.unique(np.concatenate([pool[:both], pool[both + n :]]))
        assert jaccard.differing(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi"


def hits(text, items):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fixtures.LOWER))

    w, seen, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        k = min(10, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                seen.update(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(w), len(seen), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(seen)


def test_winnowing_finds_every_window(spark):
    rng = random.Random(5)
    items = [(1, ITEM), (2, "short item here"), (3, None), (4, ""), (None, "one"), (5, " ".join(ITEM.split()[2:])), (1, ITEM), (6, "a b " * 20)]
    parts = ITEM.split()
    some = [*fixtures.rows(n=24)]
    for i in range(120):
        a, b = sorted(rng.sample(range(len(parts) + 1), 2))
        lead = fixtures.prose(rng, rng.randint(0, 12))
        cut = rng.choice(["-", " ", "; ", "\n"]).join(parts[a:b]).upper() if i % 3 else " ".join(parts[a:b])
        some.append((100 + i, f"{lead} {cut} {rng.choice(['', 'Short ITEM here', 'one', 'a b a b a b a b a b a b', lead])}", "en", "s"))
    docs = fixtures.table(spark, some, clashing=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    got = decontaminate.decontaminate(docs, bench).collect()
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = collections.Counter((i, *hits(t, items)) for i, t, *_ in some)
    assert collections.Counter((r["doc_id"], *[r[c] for c in columns]) for r in got) == want


def test_decontamination_of_no_rows(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.decontaminate(fixtures.table(spark, []), bench).collect() == []
    got = decontaminate.decontaminate(fixtures.table(spark), bench.limit(0)).collect()
    assert len(got) == len(fixtures.rows()) and not any(r["contaminated"] for r in got)


def test_secret_spans_equal_those_of_the_patterns(spark):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def plain(t):
        out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])

    rng = random.Random(2)
    parts = ["password", "token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "12345678", "AKIA", "AKIAQWERTY123456",
             "0123456789abcdef" * 2, "é", "x", "/", "\n", "secretoken", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20]
    some = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "en", "s") for i in range(400)]
    some += [(900, None, None, None), (901, "f" * 5000, "en", "s"), (None, "token=longenough", "en", "s"), some[0]]
    got = {(r["doc_id"], r["spans_text"], r["base_sha256"]): r for r in secrets.scan_secrets(fixtures.table(spark, some, clashing=True)).collect()}
    names = ["assign", "access", "hex"]
    for i, text, *_ in some:
        want = [f"{names[k]}:{s}:{e}" for s, k, e in plain(text or "")]
        sha = hashlib.sha256(",".join(want).encode()).hexdigest()
        mine = [r for k, r in got.items() if k[0] == i and k[2] == sha]
        assert mine and [x for x in mine[0]["spans_text"].split(",") if x.split(":")[0] in names] == want, text
    spans = [s["kind"] for r in got.values() for s in r["spans"]]
    assert "pem" in spans and "bearer" in spans
    assert secrets.scan_secrets(fixtures.table(spark, [])).collect() == []


def test_automata_are_minimal_and_travel_as_arrays():
    import pickle

    scanner = secrets.Scanner((secrets.Rule("ab", "(ab|cb)+"), secrets.Rule("d", "d{2,3}")))
    again = pickle.loads(pickle.dumps(scanner.all))
    assert len(again.table) == len(scanner.all.table) and scanner.spans(b"xabcb ddddd") == [(1, 0, 5), (6, 1, 9), (9, 1, 11)]


def test_language_by_codewords(spark):
    rng = random.Random(4)
    some = [(i, fixtures.prose(rng, rng.randint(4, 60), v), name, "s") for i in range(150) for name, v in [("en" if i % 2 else "de", fixtures.EN if i % 2 else fixtures.DE)]]
    held = [(1000, "which would have been there after", None, "s"), (1001, "eine große straße können wir nicht", None, "s"), (1002, None, "en", "s"),
            (1003, "12 ... 34", "en", "s"), (1004, "", None, None), (1005, "which " * 60_000, None, "s")]
    docs = fixtures.table(spark, some + held, clashing=True)
    got = {r["doc_id"]: r for r in language.identify(docs, docs.select("text", "lang")).collect()}
    assert [got[1000 + i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert got[1002]["score"] == 0 and 0.5 < got[1000]["score"] <= 1 and got[1000]["whole_text"] == "kept whole_text"
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in some) >= 148
    assert {r["lang_pred"] for r in language.identify(docs, docs.select("text", "lang").limit(0)).collect()} == {"und"}
    one = language.identify(docs, docs.where("lang = 'de'").select("text", "lang")).collect()
    assert {r["lang_pred"] for r in one} == {"de", "und"}
    assert language.identify(fixtures.table(spark, []), docs.select("text", "lang")).collect() == []


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= max(1, code.shape[1] // 5) and (np.abs(code.sum(axis=0)) < n).all()


def test_long_texts_are_judged_in_pieces_as_in_one():
    counts = {c: np.random.default_rng(i).integers(0, 50, 1 << language.LOG_FEATURES).astype(float) for i, c in enumerate("abc")}
    model = language.Model(counts)
    data = np.frombuffer(("wörter und words " * 9000).encode(), np.uint8)
    whole = model.margins(data, np.array([0, len(data)]))
    ids, skip = language.features(data, np.array([0, len(data)]))
    direct = sum(model.weights[i][~s].astype(float).sum(axis=0) for i, s in zip(ids, skip, strict=True)) / (~skip).sum()
    assert np.allclose(whole[0], direct, atol=1e-4)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    some, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = fixtures.prose(rng, rng.randint(20, 80))
        some.append((i, text if good else " ".join(f"{w}{rng.choice(['!!', '###', '$'])}" for w in text.upper().split()), "en", "s"))
        labels.append((i, int(good)))
    some += [(9000, None, None, None), (9001, "", None, None), some[0]]
    docs = fixtures.table(spark, some, clashing=True)
    truth = spark.createDataFrame(labels + [(5, 0), (7, None)], "doc_id long, quality int")
    learn = truth.where(~quality.held_out(F.col("doc_id")))
    got = quality.score_quality(docs, learn).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(some) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [i for i, in docs.where(quality.held_out(F.col("doc_id"))).select("doc_id").collect() if i is not None and i < 600]
    assert len(held) > 60 and sum((score[i] > 0.5) == (i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert len({r["score"] for r in quality.score_quality(docs, learn.limit(0)).collect()}) == 1
    assert quality.score_quality(fixtures.table(spark, []), learn).collect() == []


def test_random_indexing_sums_over_pieces_as_in_one(monkeypatch):
    text = fixtures.prose(random.Random(1), 400).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 100, 100, len(text)])
    ids, first = quality.word_ids(data, offsets)
    index = quality.index_vectors()
    whole, parts = np.zeros((1 << quality.LOG_WORDS, quality.DIMS)), np.zeros((1 << quality.LOG_WORDS, quality.DIMS))
    quality.context_sums(ids, first, index, whole)
    monkeypatch.setattr(quality, "STRIDE", 7)
    quality.context_sums(ids, first, index, parts)
    assert np.array_equal(whole, parts) and whole.any()


def test_rollup_follows_signed_batches_once(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", 7), (None, None, "v1", 0)], "source string, lang string, tokenizer string, tokens long"
    )
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().collect() == []
    assert rollup.apply("one", token_counts.inserted(rows)) and not rollup.apply("one", token_counts.inserted(rows))
    assert rollup.apply("two", token_counts.deleted(rows.where("tokens = 7")))
    changed = rows.where("tokens = 5").withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.lit(50))
    assert rollup.apply("three", token_counts.revised(changed)) and rollup.apply("empty", token_counts.inserted(rows.limit(0)))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert got == {("a", "en"): (2, 60), (None, None): (1, 0)}
    rows.write.parquet(f"{tmp_path}/rollup/delta-unfinished")
    assert token_counts.Rollup(spark, f"file://{tmp_path}/rollup").totals().count() == 2


def test_token_counts_are_those_of_the_vocabulary(spark):
    docs = fixtures.table(spark, clashing=True).withColumn("tokens", F.lit(-1))
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    for r in token_counts.count_tokens(docs, "text", "tokens").collect():
        assert r["tokens"] == len(encode(r["text"] or ""))


def test_shared_dir_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named if named else shared_dir(spark)


def test_secret_spans_where_values_hold_keywords():
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(8)
    scanner = secrets.compiled((*secrets.BASE_RULES, *secrets.MORE_RULES))
    for _ in range(3000):
        text = "".join(rng.choice(["token=", "secret:", "token", "x", "=", ":", "ab", " ", "'", "apikey", "eyJ", "."]) for _ in range(rng.randint(0, 25)))
        wanted = [(m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
        assert [(s, e) for s, r, e in scanner.spans(text.encode()) if r == 0] == wanted, text


@pytest.mark.parametrize("text", ["token=xsecret:" + "n" * 1_000_000, "token=xsecret=" + "n" * 1_000_000, "token=" * 170_000, "eyJ" * 300_000, "AKIA" * 250_000])
def test_secret_scan_is_linear(text):
    start = time.process_time()
    secrets.compiled((*secrets.BASE_RULES, *secrets.MORE_RULES)).spans(text.encode())
    assert time.process_time() - start < 15


def test_token_counts_of_long_runs(spark):
    encoding = token_counts.encoder(token_counts.VOCABULARY)
    count = token_counts.counter(encoding)
    rng = random.Random(3)
    blanks = [" ", "\n", "\t", " ", "\r\n", " "]
    for _ in range(60):
        parts = [rng.choice(["word", "'s", "12", "...", "é", "\x1c"]) if rng.random() < 0.5 else rng.choice(blanks) * rng.randint(990, 2500) for _ in range(rng.randint(1, 6))]
        text = "".join(parts)
        assert count(text) == len(encoding.encode_ordinary(text)), parts
    long = [(i, c * 2_000_000 + "x") for i, c in enumerate([" ", "\n", "a", "1"])] + [(9, " " * 1_000_000)]
    got = {r[0]: r[1] for r in token_counts.count_tokens(spark.createDataFrame(long, "id int, text string"), "text", "n").select("id", "n").collect()}
    assert got == {0: 2_000_000, 1: 1_000_002, 2: len(encoding.encode_ordinary("a" * 2_000_000 + "x")), 3: got[3], 9: 1_000_000}
