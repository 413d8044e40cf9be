"""Packing, Merkle manifests and collocations against brute force, with awkward rows."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

pytest.importorskip("veldspar.llm.registry")
from pyspark.sql import functions as F  # noqa: E402
from veldspar.llm import collocations, merkle, packing  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = [None, "", " \n\t ", "one", "One TWO", "it's we'll DON'T", "a-'s 'st x1y22.3z a''re <|ENDOFTEXT|>", "é é Å Å ß İ ΣΑΣ", "a b c\u0085d", "12 345,6", "x<|endoftext|>y <|startoftext|>", "漢字 かな ✓✓", "w" * 700, "a\x00b\x1cc\x0bd"]


# Packing


def test_words_encode_as_texts_do():
    """The encoder gives the library's ids, on awkward and random texts."""
    text = packing.tokenizer_text()
    assert packing.by_words(json.loads(text))
    enc, tok = packing.Encoder(text), Tokenizer.from_str(text)
    rng = random.Random(2)
    alphabet = ["a", "b", "E", "'s", "'", "1", " ", "\n", "\t", " ", "́", "é", "-", "<|endoftext|>", "<|", "ß", "İ", "漢", "\x1c", "\x0b", " ", ".", "Å"]
    some = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + [" ".join(AWKWARD[3:]) * 400]
    for _ in range(2):  # learned, then remembered
        got = [ids[a:e].tolist() for ids, at in enc.batch(pa.array(some)) for a, e in zip(at[:-1], at[1:])]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in some]
    form = json.loads(text)
    form["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    assert not packing.by_words(form)


def checked(rows, ids_of, tokens, segments, loss_limit, loss_of):
    """All ids in one piece each, limits kept, offsets without gaps; the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    want = Counter()
    for d, ids in ids_of:
        want[(d, len(ids))] += 1
    assert {k: sum(p.length for p in v) for k, v in by_doc.items()} == {(d, n): n * c for (d, n), c in want.items()}
    whole = defaultdict(set)
    for d, ids in ids_of:
        whole[(d, len(ids))].add(tuple(ids))
    for k, v in by_doc.items():
        for p in v:
            assert p.length > 0
            assert p.ids_crc32 in {zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids in whole[k]}
    padding = 0
    for v in by_sequence.values():
        v.sort(key=lambda p: p.offset)
        assert [p.offset for p in v] == [0, *itertools.accumulate(p.length for p in v)][:-1]
        n = sum(p.length for p in v)
        assert n <= tokens and len(v) <= segments and sum(loss_of(p) for p in v) <= loss_limit
        padding += 0 if n & (n - 1) == 0 else tokens - n
    return padding


def test_packing_documents(spark):
    rng = random.Random(6)
    tok = Tokenizer.from_str(packing.tokenizer_text())
    some = AWKWARD + [" ".join(rng.choice(["alpha", "Beta", "gamma,", "42"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["long text " * 9000] + ["tiny"] * 300
    rows = [(i, t, "x", 1) for i, t in enumerate(some)] + [(None, "no id", "y", 2), (3, "one", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, length long").repartition(3)
    ids_of = [(d, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _, _ in rows]
    sequences, width = packing.pack(df, packing.tokenizer_text())
    got = packing.pieces(sequences, width).collect()
    assert checked(got, ids_of, 4096, 64, 4096, lambda p: p.length - (p.start == 0)) == 0
    assert all(p.loss == p.length - (p.start == 0) for p in got)
    assert packing.pieces(*packing.pack(df.limit(0), packing.tokenizer_text())).count() == 0


def test_packing_instructions_under_three_limits(spark):
    """Prompts bear no loss; segments and loss run out before tokens do."""
    rng = random.Random(7)
    tok = Tokenizer.from_str(packing.tokenizer_text())
    rows = [(i, " ".join(["answer"] * rng.randrange(0, 40)), " ".join(["ask"] * rng.randrange(0, 60)) or None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2)
    heads = {i: tok.encode(p or "", add_special_tokens=False).ids for i, _, p in rows}
    ids_of = [(i, heads[i] + tok.encode(t, add_special_tokens=False).ids + [2]) for i, t, _ in rows]

    def loss(p):
        return max(0, p.start + p.length - max(p.start, max(1, len(heads[p.doc_id]))))

    for limits in ((128, 3, 40), (64, 8, 64), (100, 2, 1), (16, 1, 16)):
        got = packing.pieces(*packing.pack(df, packing.tokenizer_text(), prompt_col="prompt", tokens=limits[0], segments=limits[1], loss=limits[2])).collect()
        assert checked(got, ids_of, *limits, loss) == 0
        assert all(p.loss == loss(p) for p in got)


def test_dot_product_fills_by_scarce_limits():
    """Where segments are scarce, long examples go first; an example that fits none is cut."""
    def example(n):
        return packing.Example(n, np.zeros(n, np.uint32), 1)

    p = packing.Packer(tokens=100, segments=2, loss=100)
    p.window = [example(n) for n in (10, 60, 40, 55, 45)]
    got = [[x.length for x in s] for s in p.pack(True)]
    assert got[0] == [60, 40] and got[1] == [55, 45]
    p.window = [example(130)]
    assert [[x.length for x in s] for s in p.pack(True)] == [[100], [16], [8], [4], [2]]
    with pytest.raises(ValueError):
        packing.Packer(segments=0)


# Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    tree = [nodes]
    while len(tree[-1]) > 1:
        tree.append([h(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
    return tree


def brute_manifest(rows):
    """Leaf to (subroot, root, siblings by level: before, after) by (source, place)."""
    groups = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n = r
        groups[source].append((doc_id is not None, doc_id or 0, h(*map(value, (doc_id, source, lang, n, text))), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = []
            for tree, at in ((trees[s], i), (top, g)):
                for nodes in tree[:-1]:
                    lo = at - at % 3
                    path.append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 3])))
                    at //= 3
            doc_id, text, lang, source, n = r
            cur = leaf
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                cur = h(*map(value, (doc_id, source, lang, n, text.replace("\n", ""))))
            for a, b in path:
                cur = h(a, cur, b)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(*[a + b for a, b in path]), cur, cur == top[-1][0]))
    return out


def manifest(spark, df, tmp, depth):
    t = F.when(F.crc32(df["doc_id"].cast("string").cast("binary")) % 2 == 0, F.translate(df["text"], "\n", ""))
    merkle.build(df, tmp, found={"text": F.when(t != df["text"], t)}, depth=depth)
    return sorted((tuple(r) for r in merkle.check(spark, tmp, depth=depth).drop("path").collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_merkle_against_brute_force(spark, tmp_path, depth):
    rng = random.Random(9)
    rows = [(i, f"text {i}\nmore" if i % 3 else f"plain {i}", rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", "é", "Z"]), i if i % 5 else None) for i in range(150)]
    rows += [(None, "no id\n", "en", "a", 1), (None, None, None, None, None), (7, "", "en", "solo", 0), (7, "twice\n", "de", "b", 6), (7, "twice\n", "de", "b", 6), (8, "漢字\n" * 5000, "ja", "", 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string").repartition(3)
    assert manifest(spark, df, f"file://{tmp_path}/m", depth) == sorted(brute_manifest(rows), key=repr)


def test_merkle_small(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    one = [(4, "a\nb", "en", "s", 3)]
    assert manifest(spark, spark.createDataFrame(one, kind), f"file://{tmp_path}/one", 6) == brute_manifest(one)
    assert manifest(spark, spark.createDataFrame([], kind), f"file://{tmp_path}/none", 6) == []


def test_merkle_paths_fold():
    nodes = [merkle.sha(str(i)) for i in range(23)]
    for fanout in (2, 3, 5):
        tree = merkle.levels(nodes, fanout, 9, True)
        for node, path in zip(nodes, merkle.paths(tree, fanout)):
            assert merkle.fold(node, path) == tree[-1][0]
            assert merkle.fold(merkle.sha("other"), path) != tree[-1][0]
    # A bucket that is not all of its group keeps hashing a lone node.
    assert merkle.levels(nodes[:1], 3, 2, False)[-1] == [h(h(nodes[0]))]


# Collocations


def pieces_of(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(2, 1000), (5, 7), (1, 100_000)])
def test_collocations_against_brute_force(spark, least, top, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 4000)
    rng = random.Random(11)
    vocab = ["a", "b", "No", "the", "é", "it's", "x\x01y", "c"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".\n", "\t", "  ", "\x0b", "\x1c"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "en", "en", "de", None, ""])) for t in texts] + [(None, "en"), ("", "en"), (" \n,;", "de"), ("a a a a a a", "fr"), ("und word " * 40, "und"), ("q" * 3000 + " " + "q" * 3000, "en")] + [("one two three four five six", "en")] * 6
    df = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)], "doc_id long, text string, lang string, key string").repartition(3)
    got = collocations.collocations(df, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, top)


def test_collocations_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(df).count() == collocations.collocations(df.limit(0)).count() == 0


def test_automaton_states():
    """States hold every substring once, with its end places; a suffix link leads to a state of more end places."""
    rng = random.Random(5)
    for _ in range(60):
        n, depth = rng.randrange(0, 40), rng.randrange(1, 6)
        codes = np.array([rng.randrange(1, 4) for _ in range(n)], np.int64)
        linked = np.array([i > 0 and rng.random() < 0.8 for i in range(n)], bool)
        want = Counter()
        for e in range(n):
            for m in range(1, depth + 1):
                if e - m + 1 < 0 or (m > 1 and not linked[e - m + 2]):
                    break
                want[tuple(codes[e - m + 1 : e + 1].tolist())] += 1
        s = collocations.automaton(codes, linked, depth)
        got = Counter()
        for at, longest, shortest, count in zip(*(s[k].tolist() for k in ("at", "longest", "shortest", "count"))):
            for m in range(shortest, longest + 1):
                p = tuple(codes[at - m + 1 : at + 1].tolist())
                assert p not in got
                got[p] = count
            if shortest > 1:
                assert want[tuple(codes[at - shortest + 2 : at + 1].tolist())] > count
        assert got == want


def test_scores_pass_64_bits(spark):
    """1000 a n and l r beyond 64 bits, exactly."""
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", b"\0\0\0\1", 1, big), ("en", b"\0\0\0\2", 1, big - 7), ("en", b"\0\0\0\1\0\0\0\2", 2, big - 11)], "lang string, key binary, m int, f long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    (r,) = collocations.scored(counts, totals).collect()
    assert r.score == 1000 * (big - 11) * 3 * big // (big * (big - 7))
