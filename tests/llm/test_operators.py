"""Operators of the training-data pipeline against brute force, on small fixtures with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("veldspar.llm.registry")
from veldspar.llm import _text, decontaminate, jaccard, langid, mixing, pii, sharding, suffix_array, suffix_dedup, tokenstore, url_filter, vector_dedup  # noqa: E402
from veldspar.llm.components import connected_components  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [a + b for a in ("th", "er", "on", "an", "re") for b in ("e", "ing", "tion", "ly", "ed", "ou", "")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = prose(rng, 120)
    out = [base, base, None, "", "   \n\t", "one", "One", "two words", "é ß 漢字 ✓ a b", "a\x00b " * 30, base.upper()]
    for k in range(25):
        w = base.split()
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = rng.choice(VOCAB) + str(k)
        out.append(" ".join(w))
    shared = prose(rng, 60)
    out += [prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 40) for _ in range(12)]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    out += [("x" * 300 + " ") * 3, "y" * 49, "y" * 50, "y" * 51, prose(rng, 20000)]
    return out


def frame(spark, texts):
    rows = [(i, t, "en", 5, 1) for i, t in enumerate(texts)] + [(None, "no id here at all", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long, bucket long").repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def least_components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def shingle_set(t):
    w = words(t)
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(texts):
    """Sets and smallest ids of classes of texts by id (a list: by place)."""
    sets = {i: shingle_set(t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, least_components(sets, links)


@pytest.mark.parametrize("frequent", [64, 3])
def test_jaccard(spark, texts, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    sets, comp = brute_jaccard(texts)
    got = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got[None].component_id is None and got[None].n_shingles == 1
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), comp[i]), i


def test_jaccard_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f g")] * 3 + [(2, "a b c d e f g")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.jaccard_components(rows).orderBy("doc_id").collect()] == [(2, 3, 2)] + [(5, 3, 2)] * 3


def test_prefixes_share_enough():
    """Any two sets at the threshold share the smaller number of matches within their prefixes."""
    rng = np.random.default_rng(3)
    sketch = np.zeros((jaccard.SKETCH_ROWS, 1 << jaccard.SKETCH_BITS), np.uint32)
    sketch[:, rng.integers(0, 1 << jaccard.SKETCH_BITS, 20000)] = 50
    for _ in range(60):
        n = int(rng.integers(5, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = x.copy()
        drop = int(len(x) * 0.1)
        y = np.unique(np.concatenate([y[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        at = np.cumsum([0, len(x), len(y)])
        owner, token, layer, matches, _ = jaccard.prefixes(np.concatenate([x, y]), at, sketch)
        need = min(matches[owner == 0][0], matches[owner == 1][0])
        a, b = (set(token[(owner == k) & (layer <= need)].tolist()) for k in (0, 1))
        assert len(a & b) >= need


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 6000 + k) for k in range(200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.root for r in connected_components(df).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    want = least_components(ids, [e for e in edges if e[0] != e[1]])
    assert set(got) == ids
    for group in (got, want):
        assert len(group) == len(ids)
    pairs = {}
    for i in ids:
        assert pairs.setdefault(got[i], want[i]) == want[i]
    assert len(pairs) == len(set(want.values()))


def test_tokens_round_trip(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    more = [*texts, "two  spaces", " lead", "trail ", "a \n b", "don't stop, it's 12,5!", "x <|endoftext|> y", "tab\t and\x1c odd"]
    df = frame(spark, more)
    path = f"file://{tmp_path}/store"
    width = tokenstore.build(df, tokenstore.tokenizer_text(), path, pack_bytes=4000)
    got = tokenstore.read(spark, path, width, with_ids=True).orderBy("start").collect()
    tok, start = Tokenizer.from_str(tokenstore.tokenizer_text()), 0
    for r, (i, t) in zip(got, [(None, "no id here at all"), *enumerate(more)], strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/store").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_segments_keep_ids(monkeypatch):
    """Texts of awkward pieces, encoded by segments, forgetting often, against the library's whole texts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "a", "b1", "don't", "I'll", "é", "漢字", "\u00a0", "\u2003", "  x", "\u3000", ".", ",", "!?", "<|endoftext|>", "12", "3.5", "x2y", "\t", "\x1c", "\x85", "'s", "'", "_", "-", "ß", "²", "½", "Ω", "\x00", "\x7f", "🙂"]
    more = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)] + [None, "", " ", "  "]
    text = tokenstore.tokenizer_text()
    tok = Tokenizer.from_str(text)
    monkeypatch.setattr(tokenstore, "REMEMBERED", 300)
    monkeypatch.setattr(tokenstore, "STEP_BYTES", 2000)
    enc = tokenstore.Encoder(text)
    assert enc.cuttable
    got = [x.tolist() for ids, stops in enc.batch(pa.array(more)) for x in np.split(ids, stops[:-1])]
    assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in more]


def test_segments_other_tokenizers():
    """A tokenizer of another form gets whole texts."""
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    form = json.loads(tokenstore.tokenizer_text())
    assert tokenstore.byte_level(form)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        assert not tokenstore.byte_level({**form, **change})
    lower = json.dumps({**form, "normalizer": {"type": "Lowercase"}})
    word = tokenstore.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    for text in (lower, word):
        enc, tok = tokenstore.Encoder(text), Tokenizer.from_str(text)
        some = ["Hello There  world", "A b, c", None, "İstanbul x"]
        got = [x.tolist() for ids, stops in enc.batch(pa.array(some)) for x in np.split(ids, stops[:-1])]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in some]


def test_tokens_one_id(spark, tmp_path):
    """A table in which most rows have one id, or none: packs stay small, nothing is lost."""
    rng = random.Random(8)
    rows = [(5 if k % 3 else None, prose(rng, 60)) for k in range(150)] + [(k, prose(rng, 60)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit("p")).withColumn("uid", F.lit(1)).withColumn("tie", F.lit(1)).repartition(3)
    path = f"file://{tmp_path}/store"
    width = tokenstore.build(df, tokenstore.tokenizer_text(), path, pack_bytes=4000)
    got = tokenstore.read(spark, path, width).orderBy("start").collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(-1 if i is None else i for i, _ in rows)
    assert spark.read.parquet(f"{path}/manifest").agg(F.max("n_docs")).first()[0] <= 40


def test_tokens_notice_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello there world " * 20)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    width = tokenstore.build(df, tokenstore.tokenizer_text(), path)
    broken = spark.read.parquet(f"{path}/store").withColumn("digests", F.expr("concat(X'00', substring(digests, 2))"))
    broken.write.partitionBy("kind").parquet(f"{path}2/store")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}2/manifest")
    with pytest.raises(Exception, match="recipe"):
        tokenstore.read(spark, f"{path}2", width).collect()


def test_tokens_empty(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    width = tokenstore.build(spark.createDataFrame([], "doc_id long, text string"), tokenstore.tokenizer_text(), path)
    assert tokenstore.read(spark, path, width).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_matches_plain_expressions():
    rng = random.Random(9)
    parts = ["a@b.co", "x.y+z@m-1.example.com", "@", "..", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (013) 555-9871", "+49", " ", "-", "é", "q@q", "a@b@c.de", "007.08.09.010", "\n", "(", ")", "+", "9"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert sorted((a, pii._ORDER[k], b) for a, k, b in pii.base_spans(t)) == brute_pii(t), t
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000):
        pii.find(t)


def test_pii_added_and_context(spark):
    t = "IBAN DE89 3704 0044 0532 0130 00 and call 555-123-4567 or version 1.2.3.4"
    kinds = [k for k, *_ in pii.find(t)]
    assert "iban" in kinds and "phone_local" in kinds
    assert not any(k == "iban" for k, *_ in pii.find("IBAN DE89 3704 0044 0532 0130 01"))
    assert pii.find("555-123-4567") == [] and pii.find(None) == []
    df = spark.createDataFrame([(1, t, "x"), (2, None, "y")], "doc_id long, text string, kind string")
    rows = pii.detect(df, redacted=True).orderBy("doc_id").collect()
    assert "<iban>" in rows[0].redacted and rows[1].redacted is None and rows[1].pii == []


def brute_near(rows, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    n = {i: sum(i in p for p in links) for i, _ in rows}
    return n, least_components([i for i, _ in rows], links)


@pytest.mark.parametrize("rows", [None, 50])
def test_vectors_recall(spark, rows, monkeypatch):
    if rows:
        monkeypatch.setattr(vector_dedup, "LEAST_BLOCK", rows)
        monkeypatch.setattr(vector_dedup, "MOST_BLOCK", rows)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    x[300:500] = x[7] + rng.normal(size=(200, 16)) * 0.15
    x[500:560] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [1.0, None]), (805, [1.0, 2.0]), (806, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("raw", F.lit(1)).repartition(3)
    n, comp = brute_near(rows)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    found = sum(min(got[i].n_links, n[i]) for i in n)
    assert all(got[i].n_links <= n[i] for i in n) and found >= 0.9 * sum(n.values())
    assert sum(got[i].component_id == comp[i] for i in comp) >= 0.99 * len(comp)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "rank"), [(64, 4), (768, 4), (768, 8)])
def test_vectors_recall_low_rank(spark, dim, rank):
    """Vectors near a few directions of many: displacements are not spread over all dimensions."""
    rng = np.random.default_rng(dim + rank)
    near = rng.normal(size=(150, rank))[rng.integers(0, 150, 800)] + 0.15 * rng.normal(size=(800, rank))
    x = near @ rng.normal(size=(rank, dim))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.triu(unit @ unit.T >= 0.95, 1)
    want = (links | links.T).sum(1)
    comp = least_components(range(len(x)), np.argwhere(links).tolist())
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert want.sum() > 2000
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert all(got[i].component_id == comp[i] for i in comp)


def test_language_mixture(spark):
    rng = random.Random(5)
    alphabets = {"aa": ["kata", "kolo", "taka", "loko"], "bb": ["wen", "wyn", "newy", "yew"], "cc": ["zuß", "ßuz", "uzuß", "zzu"]}
    rows = [(i, " ".join(rng.choice(alphabets[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(alphabets) * 30)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", None), (902, rows[0][1], None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    mixed = spark.createDataFrame([(1001, rows[0][1] + " " + rows[1][1], None), (1002, "", None), (1003, rows[2][1] * 200, None)], df.schema)
    out = {r.doc_id: r.language for r in langid.identify(df.unionByName(mixed.where("doc_id > 1001")), model).collect()}
    assert sum(out[i].lang == lang for i, _, lang in rows) >= 89 and out[1002].lang == "und" and out[1003].lang == "cc"
    assert out[900].lang == out[901].lang == "und" and out[901].score == 0.0
    two = langid.identify(mixed, model).where("doc_id = 1001").first().language
    assert set(two.languages) == {"aa", "bb"} and abs(two.proportions[0] - 0.5) < 0.2
    none = langid.train(df.where("lang is null and false"))
    assert {r.language.lang for r in langid.identify(df, none).collect()} == {"und"}


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    table = spark.createDataFrame([(i, int(k), [float(v) for v in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    targets = np.array([0.5, 0.3, 0.2]) * n.sum()
    steps, even = mixing.fit_rates(table, targets)
    r = np.array([x.rate for x in table.withColumn("rate", mixing.rate_column(steps, even, mixing.RIDGE)).orderBy("doc_id").collect()])
    assert (r >= 0).all() and np.abs((r * n) @ p - targets).max() <= 0.01 * targets.sum()


def posterior_table(spark, n, p):
    return spark.createDataFrame([(i, int(k), [float(v) for v in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")


def fitted(table, targets):
    pulls, even = mixing.fit_rates(table, targets)
    return np.array([x.rate for x in table.withColumn("rate", mixing.rate_column(pulls, even, mixing.RIDGE)).orderBy("doc_id").collect()])


def test_mixing_meets_each_target(spark, recwarn):
    """The production shares: each domain within the tolerance of its own target, many rates at 0."""
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.dirichlet([20, 1, 0.4], 700), rng.dirichlet([3, 3, 0.4], 60), rng.dirichlet([1, 0.5, 20], 100)])
    n = rng.integers(1, 500, len(p))
    table = posterior_table(spark, n, p)
    targets = mixing.default_targets(table, mixing.SHARES, mixing.DOMAINS)
    r = fitted(table, targets)
    assert (r >= 0).all() and (r == 0).mean() > 0.1
    assert (np.abs((r * n) @ p - targets) <= mixing.TOLERANCE * targets).all()
    assert not [w for w in recwarn if "targets" in str(w.message)]


def test_mixing_says_what_it_can_not_meet(spark):
    n, p = np.array([10, 20, 30]), np.array([[0.5, 0.4, 0.1], [0.6, 0.3, 0.1], [0.3, 0.6, 0.1]])
    table = posterior_table(spark, n, p)
    targets = np.array([30.0, 29.0, 1.0])
    with pytest.warns(UserWarning, match="no rates found"):
        r = fitted(table, targets)
    # Stationary: no row's rate would lower the squares of the gaps.
    slope = p @ ((r * n) @ p - targets) / targets.sum()
    assert (slope > -1e-4).all() and np.abs(slope[r > 0]).max() < 1e-4
    even = posterior_table(spark, n, np.full((3, 3), 1 / 3))
    with pytest.warns(UserWarning, match="no rates found"):
        r = fitted(even, targets)
    assert np.ptp(r) == 0 and abs((r * n).sum() / targets.sum() - 1) < 1e-4
    with pytest.raises(RuntimeError, match="did not converge"):
        mixing.fit_rates(table, targets, most_passes=1)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (3, ""), (4, "bad nasty words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(docs, none).count() == 4
    assert mixing.mix(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, "prime"), (1, "prime"), (4, "toxic"), (99, "plain"), (None, "plain")], "doc_id long, domain string")
    assert mixing.mix(docs, labels).where("rate >= 0").count() == 4


def brute_windows(doc, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (doc or "").translate(LOW))
    hit, found = set(), set()
    for k, t in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        n = min(10, len(b))
        grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j : j + n]) in grams:
                hit.update(range(j, j + n))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [10**6, 30])
def test_decontaminate(spark, texts, most):
    items = [(1, " ".join(texts[0].split()[20:45])), (2, "one"), (3, None), (4, "..."), (5, texts[40]), (10, texts[40]), (6, "漢字 é"), (7, "two words"), (5, "y" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, texts).select("doc_id", "text", "n")
    scanned = decontaminate.scan(df, bench, max_windows=most)
    got = {r.doc_id: r.contamination for r in scanned.collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute_windows(t, items), i
    clean = {r.doc_id: r.text for r in decontaminate.remove_spans(scanned, length_col="n").collect()}
    for i, t in enumerate(texts):
        if not got[i].n_hit:
            assert clean[i] == t
        elif i in clean:
            assert brute_windows(clean[i], items[:1])[1] == 0
    once = decontaminate.clean(df, bench, length_col="n", max_windows=most)
    assert {r.doc_id: r.text for r in once.collect()} == clean
    assert decontaminate.scan(df.limit(0), bench, max_windows=most).count() == 0
    assert {r.contamination.n_hit for r in decontaminate.scan(df, bench.limit(0)).collect()} == {0}


def test_decontaminate_null_item_and_names(spark, texts):
    """An item without id hits but has no name; a column of the operator's own name is replaced."""
    bench = spark.createDataFrame([(None, texts[40]), (None, "one"), (8, "one")], "item_id long, text string")
    df = frame(spark, texts).select("doc_id", "text", "n").withColumn("contamination", F.lit("x"))
    got = {r.doc_id: r.contamination for r in decontaminate.scan(df, bench).collect()}
    assert got[40].n_hit == got[40].n_words and got[40]["items"] == brute_windows(texts[40], [(8, "one")])[2] and got[5]["items"] == ["8"]
    assert decontaminate.clean(df, bench, length_col="n").columns == ["doc_id", "text", "n"]


def test_window_set_size():
    """About 40 bytes a window, whatever their number."""
    import pyarrow as pa

    rng = random.Random(2)
    from veldspar.llm._text import ALNUM, words

    parts = []
    for k in range(200):
        body = np.frombuffer(prose(rng, 500).encode(), np.uint8)
        starts, ends, _ = words(body, np.array([0, len(body)]), ALNUM)
        parts.append((str(k), body.tobytes(), starts, ends))
    known = decontaminate.WindowSet.make(parts, 10)
    n = sum(len(w[0]) for w in known.windows.values())
    assert n == 200 * 491 and known.nbytes < 45 * n
    text = parts[7][1].decode()
    assert [x[:3] for x in decontaminate.scan_batch(pa.array([text, "no " + text[30:90]]), known)][0] == (500, 500, ["7"])


def test_clashing_names(spark):
    """A column that has the name of an added one is replaced."""
    df = spark.createDataFrame([(1, "mail a@b.co now", "en")], "doc_id long, text string, lang string")
    df = df.withColumn("pii", F.lit(1)).withColumn("language", F.lit(2)).withColumn("posterior", F.lit(3)).withColumn("n_tokens", F.lit(4)).withColumn("redacted", F.lit(5))
    assert pii.detect(df, redacted=True).select("pii", "redacted").first().redacted == "mail <email> now"
    assert langid.identify(df, langid.train(df)).select("language.lang").first().lang == "en"
    model = mixing.train(df, spark.createDataFrame([], "doc_id long, domain string"))
    assert mixing.posteriors(df, model).select("n_tokens", "posterior").first().n_tokens == 5
    labels = spark.createDataFrame([(1, "plain")], "doc_id long, domain string")
    assert "pii" in mixing.resample(df, labels).columns
    empty = df.limit(0)
    assert pii.detect(empty).count() == langid.identify(empty, langid.train(empty)).count() == mixing.resample(empty, labels).count() == 0


def test_keep_first_keeps_one_row(spark, texts):
    """One row of each class, also where its rows share an id or have none; rows without words stay."""
    a, b = texts[0], texts[50]
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (3, b + " zz"), (4, None), (4, ""), (None, a), (None, a), (None, None), (9, texts[60]), (9, texts[61])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    got = jaccard.keep_first(df).collect()
    kept = sorted(((-1 if r.doc_id is None else r.doc_id), (r.text or "")[:20]) for r in got)
    want = [(-1, a), (-1, None), (1, b), (4, None), (4, ""), (9, texts[60]), (9, texts[61])]
    assert kept == sorted((i, (t or "")[:20]) for i, t in want)
    plain = spark.createDataFrame([(5, a), (6, a), (7, b)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_first(plain).collect()) == [5, 7]


def test_jaccard_checks_names(spark, texts, monkeypatch):
    """Sets of one name are noticed by their second hashes, the names made anew, and the classes are right."""
    whole = jaccard.set_keys

    def clumsy(hashes, at, salt=None):
        out = whole(hashes, at, salt or 0)
        return out & np.uint64(1) if salt == 0 else out  # the check is made without a salt

    monkeypatch.setattr(jaccard, "set_keys", clumsy)
    few = {1: texts[0], 2: texts[0], 3: texts[50], 4: texts[60], 5: texts[61]}
    df = spark.createDataFrame(list(few.items()), "doc_id long, text string").coalesce(1)
    assert jaccard.jaccard_links(df)[2] == 1
    sets, comp = brute_jaccard(few)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == {(i, len(sets[i]), comp[i]) for i in few}


def test_shingles_depend_on_order():
    """All 5-grams of eight words, and words whose letters collide modulo 2**64, have hashes of their own."""
    eight = ["a", "b", "c", "no", "yes", "x", "0", "1"]
    body = np.frombuffer(" ".join(eight).encode(), np.uint8)
    s, e, _ = _text.words(body, np.array([0, len(body)]), _text.SPACED)
    for family, value in enumerate((_text.VALUE, _text.VALUE2)):
        wh = _text.word_hashes(body, s, e, value, _text.LONG)
        every = np.array(list(itertools.product(range(8), repeat=5))).ravel()
        assert len(np.unique(_text.gram_hashes(wh[every], 5, family)[::5])) == 8**5
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    assert [len(x) for x in jaccard.exact_sets([f"{thue} {other}".encode(), thue.encode(), b"", b" \n"])] == [1, 1, 0, 0]
    body = np.frombuffer(f"{thue} {other}".encode(), np.uint8)
    s, e, _ = _text.words(body, np.array([0, len(body)]), _text.SPACED)
    assert len(set(_text.word_hashes(body, s, e, long=_text.LONG).tolist())) == 2
    # Runs longer than the table of multipliers.
    many = _text.mix(np.arange(400, dtype=np.uint64))
    turned = many.copy()
    turned[[10, 138]] = turned[[138, 10]]
    assert _text.gram_hashes(many, 400)[0] != _text.gram_hashes(turned, 400)[0]


def test_exact_sets_do_without_hashes(monkeypatch):
    rng = random.Random(3)
    some = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    want = [shingle_set(t) for t in some]
    for bits in (64, 3):
        whole = jaccard.gram_hashes
        with monkeypatch.context() as m:
            m.setattr(jaccard, "gram_hashes", lambda wh, n, family=0, bits=bits: whole(wh, n, family) >> np.uint64(64 - bits))
            got = jaccard.exact_sets([t.encode() for t in some])
        assert [len(x) for x in got] == [len(x) for x in want]
        assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for i in range(60) for j in range(i))


@pytest.mark.parametrize("frequent", [64, 3])
def test_jaccard_small_vocabulary(spark, frequent, monkeypatch):
    """Texts of eight words, where shingles of the same words in another order abound."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(60)
    eight = ["no", "yes", "maybe", "a", "b", "0", "1", "Red"]
    some = ["no yes yes no maybe", "yes no no yes maybe", "a b b a 0", "b a a b 0", "0 1 1 0", "1 0 0 1", "red b a b red", "b red a red b"]
    for _ in range(60):
        base = [rng.choice(eight) for _ in range(rng.randrange(1, 60))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(eight)
            some.append(" ".join(w))
    some = dict(enumerate(some))
    sets, comp = brute_jaccard(some)
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in some}


def test_registered_job_edits_a_stored_map(spark, tmp_path, monkeypatch):
    """With a folder of maps set, the query's second run loads the first one's map and moves only what it must."""
    spark.conf.set(sharding.MAP_SETTING, f"file://{tmp_path}/maps")
    try:
        first = {r.doc_id: r for r in sharding.op8_virtual_slots(spark, "/root/testdata/sf0.001").collect()}
        old = sharding.SlotMap.latest(spark, f"file://{tmp_path}/maps")
        grown = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
        grown = grown.union(grown.where("doc_id < 40").select(F.col("doc_id") + 1_000_000, F.concat("text", F.lit(" more"))))
        grown.write.parquet(f"file://{tmp_path}/in/documents.parquet")
        second = {r.doc_id: r for r in sharding.op8_virtual_slots(spark, f"file://{tmp_path}/in").collect()}
        new = sharding.SlotMap.latest(spark, f"file://{tmp_path}/maps")
    finally:
        spark.conf.unset(sharding.MAP_SETTING)
    assert (old.version, new.version) == (1, 2) and {r.map_version for r in second.values()} == {2}
    moved = set(old.moved(new))
    assert moved and len(moved) < len(old.shard_of) / 4
    for i, r in first.items():
        assert (second[i].shard == r.shard) == (r.virtual_slot not in moved)


def test_sharding(spark, texts, tmp_path):
    df = frame(spark, texts)
    rows = sharding.shard(df, 4, n_slots=64, map_path=f"file://{tmp_path}/map").collect()
    assert len(rows) == len(texts) + 1
    for s in range(4):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert (by[i]["size"], by[i].text_crc32) == (len(b) + 1, zlib.crc32(b))
    stored = sharding.SlotMap.load(spark, f"file://{tmp_path}/map", 1)
    assert {r.virtual_slot: r.shard for r in rows}.items() <= dict(enumerate(stored.shard_of)).items()
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    heaviest = max(sum(r["size"] for r in rows if r.virtual_slot == v) for v in range(64))
    assert max(load) - min(load) <= heaviest
    weight = {s: 10 for s in range(64)}
    old = sharding.plan_map(weight, 4, 64)
    new = sharding.rebalance(old, weight, 5)
    assert new.version == 2 and all(new.shard_of[s] == 4 or s in old.moved(new) for s in old.moved(new))
    load = [sum(weight[s] for s in range(64) if new.shard_of[s] == d) for d in range(5)]
    assert max(load) - min(load) <= 20 and len(old.moved(new)) <= 64 // 5 + 8
    assert sharding.shard(df.limit(0)).count() == 0


def test_sharding_against_brute_force(spark, texts, tmp_path):
    """Shards and places made by hand from the rows' slots; a second run moves few slots of the stored map."""
    texts = [t for t in texts if len(t or "") < 5000]
    df = frame(spark, texts)
    path = f"file://{tmp_path}/maps"
    rows = sharding.shard(df, 3, n_slots=32, map_path=path).collect()
    weight = {v: sum(r["size"] for r in rows if r.virtual_slot == v) for v in range(32)}
    load, where = [0, 0, 0], {}
    for v in sorted(range(32), key=lambda v: (-weight[v], v)):
        d = min(range(3), key=lambda d: (load[d], d))
        where[v] = d
        load[d] += max(weight[v], 1)
    assert {r.virtual_slot: r.shard for r in rows} == {r.virtual_slot: where[r.virtual_slot] for r in rows}
    for s in range(3):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        keys = [(r.virtual_slot, -1 if r.doc_id is None else r.doc_id) for r in mine]
        assert [r.slot for r in mine] == list(range(len(mine))) and keys == sorted(keys)
    more = sharding.shard(df.union(frame(spark, texts[:9])), 4, map_path=path).collect()
    assert {r.map_version for r in more} == {2} and sharding.SlotMap.latest(spark, path).version == 2
    moved = {r.virtual_slot for r in more if r.shard != where[r.virtual_slot]}
    assert 0 < len(moved) < 24


def test_sharding_copies(spark):
    """Equal texts under many ids spread over the shards; equal rows share a slot and get places of their own."""
    df = spark.createDataFrame([(i, "same text") for i in range(2000)] + [(7, "twice")] * 2, "doc_id long, text string")
    rows = sharding.shard(df, 4).collect()
    count = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(count) - min(count) < 60
    twice = [r for r in rows if r["size"] == 6]
    assert len({r.virtual_slot for r in twice}) == 1 and len({r.slot for r in twice}) == 2


def test_url_filter(spark):
    urls = ["http://a.Example.NET/en/1", "http://x.net/", "http://net/", "http://badnet/", "https://example.com/de/x", "https://sub.example.com/de/x?q#f", "http://e.org/fr/", "http://e.org/frx", None, "no scheme", "://", "http://poker-jackpot.example.com/en/1", "http://library.example.com/en/1", "http://h?x/y", "ftp://A.B#/net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        assert (got[i].host, got[i].path) == ((m[1].translate(LOW), m[2]) if m else ("", "")), u
    assert [got[i].rule for i in range(8)] == ["example.net/en/", "net/", "net/", None, "example.com/de/", "example.com/de/", "org/fr/", None]
    assert (got[0].verdict, got[1].verdict, got[11].verdict, got[12].verdict) == ("allow", "block", "block", "allow")
    assert url_filter.judge(df.limit(0), url_filter.train(url_filter.labelled_urls(spark).limit(0))).count() == 0


def test_url_model_held_out(spark):
    rows = url_filter.labelled_urls(spark).withColumn("odd", F.pmod(F.xxhash64("url"), F.lit(3)) == 0)
    model = url_filter.train(rows.where(~F.col("odd")).select("url", "label"))
    host, path = url_filter.host_path(F.col("url"))
    test = rows.where("odd").select("label", host.alias("h"), path.alias("p")).toPandas()
    import pyarrow as pa

    assert ((model.score(pa.array(test.h), pa.array(test.p)) > 0.5) == (test.label == 1)).mean() > 0.95


def test_url_words_are_not_of_the_pages(spark):
    """No part of a labelled word is a part of an unwanted host word of the pages, or holds one of four letters or more."""
    hosts = {r.host for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(url_filter.host_path(F.col("url"))[0].alias("host")).collect()}
    judged = {p for h in hosts for label in h.split(".") for p in label.split("-")} - {"www", "com", "org", "net", "example"}
    ours = {p for w in url_filter.UNWANTED for p in w.split("-")}
    assert not ours & judged
    assert not [(p, q) for p in ours for q in judged if len(q) > 3 and q in p or len(p) > 3 and p in q]
    assert not {*url_filter.WANTED} & {label for h in hosts for label in h.split(".")}


def test_url_model_held_out_words(spark):
    """Whole words held out, a fifth at a time: what the model knows of unseen hosts."""
    import pyarrow as pa

    table = url_filter.labelled_urls(spark).toPandas()
    word = table.url.str.extract(r"://(?:www\.|m\.|blog\.)?([^/]*?)\.example")[0]
    fold = word.map(lambda w: zlib.crc32(w.encode()) % 5)
    right = {0: [], 1: []}
    for k in range(5):
        model = url_filter.train(spark.createDataFrame(table[fold != k]))
        test = table[fold == k]
        parts = test.url.str.extract(r"://([^/?#]*)([^?#]*)")
        for y, p in zip(test.label, model.score(pa.array(parts[0]), pa.array(parts[1])), strict=True):
            right[y].append((p > 0.5) == (y == 1))
    print("held-out words: wanted", np.mean(right[0]), "unwanted", np.mean(right[1]), "all", np.mean(right[0] + right[1]))
    assert np.mean(right[0]) > 0.85 and np.mean(right[1]) > 0.5 and np.mean(right[0] + right[1]) > 0.7


@pytest.mark.parametrize("step", [4096, 1, 7])
def test_suffix_array(step, monkeypatch):
    monkeypatch.setattr(suffix_array, "STEP", step)
    rng = random.Random(1)
    for case in range(400):
        k = rng.choice([2, 3, 6, 30, 300, 70_000])
        t = [rng.randrange(1, k) for _ in range(rng.randrange(1, 70))] if case % 4 else ([1] * rng.randrange(9) + [2] * rng.randrange(6)) * 5
        t.append(0)
        sa = suffix_array.suffix_array(np.array(t), max(t) + 1).tolist()
        assert sa == sorted(range(len(t)), key=lambda i: t[i:])
        p = suffix_array.permuted_common_prefixes(np.array(t), np.array(sa))
        for x, y in itertools.pairwise(sa):
            n = 0
            while max(x, y) + n < len(t) and t[x + n] == t[y + n]:
                n += 1
            assert p[y] == n


def test_suffix_array_recurses(monkeypatch):
    """Names are sorted by recursion at every size, over several levels."""
    seen = []
    whole = suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda t, k: seen.append(len(t)) or whole(t, k))
    rng = random.Random(6)
    word = [[rng.randrange(1, 20) for _ in range(60)] for _ in range(40)]
    t = [x for _ in range(150) for x in rng.choice(word)] + [0]
    sa = suffix_array.suffix_array(np.array(t), 20).tolist()
    assert sa == sorted(range(len(t)), key=lambda i: t[i:])
    assert len(seen) >= 3 and all(2 * b <= a + 1 for a, b in itertools.pairwise(seen))


def test_suffix_array_of_short_strings(monkeypatch):
    """Names of bounded strings are sorted in a few rounds (the array is the same), not scanned bucket by bucket."""
    rng = random.Random(7)
    for case in range(200):
        k = rng.choice([2, 3, 6, 30, 300])
        t = [rng.randrange(1, k) for _ in range(rng.randrange(1, 90))] if case % 4 else [1, 2, 1][: rng.randrange(1, 4)] * 30
        sa = suffix_array.suffix_array(np.array([*t, 0]), 300, short=True).tolist()
        assert sa == sorted(range(len(t) + 1), key=lambda i: [*t, 0][i:])
    line = "".join(rng.choice("abcdefgh ") for _ in range(6000)).encode()
    strings = [line[i : i + rng.randrange(50, 81)] for i in range(0, 5900, 3)]
    least, calls, deal = np.arange(len(strings)), [], suffix_array._deal
    monkeypatch.setattr(suffix_array, "_deal", lambda *a: calls.append(1) or deal(*a))
    owner, at, best = suffix_dedup.repeated_windows(strings, least)
    first = {}
    for i, s in enumerate(strings):
        for j in range(len(s) - 49):
            first.setdefault(s[j : j + 50], i)
    assert all(first[strings[o][a : a + 50]] == b for o, a, b in zip(owner.tolist(), at.tolist(), best.tolist(), strict=True))
    assert len(owner) == sum(len(s) - 49 for s in strings) and len(calls) < 300


def brute_repeats(texts):
    first, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                m[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, f in zip(b, m, strict=True) if not f)
        out[i] = (len(b), sum(m), sum(1 for k in range(len(b)) if m[k] and not (k and m[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("common", [8192, 2])
def test_suffix_dedup(spark, texts, common, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    want = brute_repeats(texts)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), with_kept=True).collect()}
    for i in want:
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[i], i
    assert got[None].n_removed == 0
    assert suffix_dedup.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    t = "abcdefghij" * 8
    rows = spark.createDataFrame([(3, t), (3, t), (1, t[:60] + "zz"), (7, t)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got[0] == (1, 0) and got[1] == got[2] and got[3] == (7, 80)


def brute_rows(rows):
    """Bytes lost by each (id, text), ids compared and never two rows of one id."""
    where = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            where[b[k : k + 50]] = min(i, where.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if where[b[k : k + 50]] < i:
                m[k : k + 50] = b"\1" * 50
        out.append((i, len(b), sum(m), hashlib.sha256(bytes(c for c, f in zip(b, m, strict=True) if not f)).hexdigest()))
    return sorted(out)


def awkward_tables():
    rng = random.Random(12)
    a, b, c = (prose(rng, 90) for _ in range(3))
    yield [(1, a), (2, b)]  # nothing repeats
    yield [(1, a)]
    yield [(1, None), (2, "")]
    yield [(4, a), (4, b), (2, a[:200] + c)]  # other texts under one id
    yield [(4, a + b), (4, c), (4, c), (5, c), (3, b), (7, a[100:300])]
    yield [(9, c), (9, a + c), (9, None), (9, a + c)]


@pytest.mark.parametrize("rows", list(awkward_tables()), ids=range(6))
def test_suffix_dedup_awkward(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("first", F.lit(1)).withColumn("sha", F.lit(2))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == brute_rows(rows)
