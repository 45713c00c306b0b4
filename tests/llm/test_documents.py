import random

import numpy as np
import pytest
from compare import differences, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import catalog, mixing, repetition, tokens

DATA = "/root/testdata/sf0.001"
ENC, LENGTHS = tokens.tokenizer(tokens.vocabulary_path())
PIECES = st.lists(st.sampled_from(["word", " ", "  ", "\n", "é", "'ll", "'", "漢字", "👩‍💻", "<|endoftext|>", "12", "\t", "x" * 9, ".", "　", "，", "don't", "_", "e\u0301", "\x1c", "½", "٣", "'s", "-", "\u00a0"]), max_size=60).map("".join)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, DATA), duck(DATA), catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


@settings(max_examples=300, deadline=None)
@given(PIECES, st.sampled_from([1, 2, 3, 7, 16]))
def test_tree_reduction_is_exact(text, leaf):
    ids = tokens.encode(text, ENC, LENGTHS, leaf)
    assert ids == ENC.encode_ordinary(text) and tokens.decode(ids, ENC, leaf) == text


def test_same_as_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "naïve  \n\n 漢字 👍🏽", "x" * 9000 + " y", " " * 5000, "漢" * 6000):
        assert tokens.encode(text, ENC, LENGTHS) == t.encode(text, add_special_tokens=False).ids


def test_encode_corpus_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hi there", "c"), (3, "hi there", "c"), (None, "x", None)], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, ENC.encode_ordinary("hi there")), (3, ENC.encode_ordinary("hi there")), (None, ENC.encode_ordinary("x"))], key=str)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def slow_share(seq):
    seen, hit = set(), [False] * len(seq)
    for i in range(len(seq) - 19):
        g = seq[i : i + 20]
        if g in seen:
            hit[i : i + 20] = [True] * 20
        seen.add(g)
    return sum(hit) / len(seq) if seq else 0.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["abcdefghijklmnopqrstuvwxy", "q", "zz", "aaaaaaaaaaaaaaaaaaaaaaaaa", "Ж", "漢字の", "12 ,"]), max_size=20).map("".join))
def test_repeated_share(text):
    seq = repetition.letters(text)
    assert repetition.repeated_share(seq) == pytest.approx(slow_share(seq))


def test_bands_lose_nothing(spark):
    rng = random.Random(1)
    rnd = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for n in (45, 200, 900, 3000, 20000):
        unit, rest = rnd(max(25, n // 8)), rnd(n // 2)
        texts.append(rest + unit * max(2, (n // 2) // len(unit) + 1))
    texts += [rnd(5000), None, "", "  ", "!!!", "a" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in repetition.repetition(df, every=True).collect()}
    found = {r.doc_id for r in repetition.repetitive(df).collect()}
    assert found == {i for i, t in enumerate(texts) if slow_share(repetition.letters(t)) >= repetition.SHARE}
    assert got[5].band == "incompressible" and got[6].n_letters == 0 and got[6].share == 0.0
    assert repetition.repetitive(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5000, 30_000, 60_000, 100_000, 400_000])
@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ab", "漢字列仮名交文書簡略"])
@pytest.mark.parametrize("unit", [21, 400])
def test_no_length_hides_repetition(n, alphabet, unit):
    """Random letters of which 35 to 45 % come again, in pieces as short as counts, as far away as can be."""
    rng = random.Random(n)
    fresh = "".join(rng.choices(alphabet, k=int(n * 0.6)))
    starts = rng.sample(range(len(fresh) - unit), int(n * 0.4) // unit)
    text = fresh + "".join(fresh[i : i + unit] for i in starts)
    assert repetition.repeated_share(text) >= repetition.SHARE
    assert repetition.measure(text)[4] >= repetition.SHARE


def test_bands_reject():
    rng = random.Random(4)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    assert repetition.measure(noise)[3:] == ("incompressible", None) and repetition.measure("spam and eggs " * 500)[3] == "repetitive"
    assert repetition.measure(noise[:3000])[3] == "suspect" and repetition.measure("x" * 20)[3] == "short"


def test_raking():
    rng = np.random.default_rng(2)
    s, lang, topic = (rng.integers(0, k, 60) for k in (3, 2, 4))
    tok = rng.integers(10, 90, 60).astype(float)
    share, cap = np.array([0.5, 0.3, 0.2]), np.array([3.0, 2.0, 4.0])
    w, total = mixing.rake(s, lang, topic, tok, share, cap)
    assert np.allclose(np.bincount(s, w * tok) / total, share) and (w <= cap[s] + 1e-9).all() and (w >= 0).all()
    w, total = mixing.rake(s, lang, topic, tok, share, cap, total / 3)
    assert np.allclose(np.bincount(lang, w * tok) / total, np.bincount(lang, tok) / tok.sum(), atol=1e-6)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randrange(5, 60)), rng.choice(["en", "EN", None, "de"]), rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.choice(["p", "q", None]), "x") for i in range(900)]
    rows += [(None, "text", "en", "a", "p", "x"), (1000, None, "en", "a", "p", "x"), (1001, "", "en", "b", "p", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, project string, w string")
    target = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.4, 4), ("none", 0.0, None), ("c", 0.4, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.shares(docs, target).collect()
    caps = {"a": 1, "b": 3, "c": 4, "none": 0}
    for r in got:
        assert abs(r.share - r.target_share) < 0.02 and r.most_copies <= caps[r.source]
    assert {(r.source, r.share_met, r.cap_kept) for r in mixing.kept(docs, target).collect()} == {(x, True, True) for x in "abc"}
    sides = mixing.marginals(docs, target).collect()
    assert {r.value for r in sides if r.kind == "language"} == {"", "en", "de"} and {r.value for r in sides if r.kind == "topic"} == {"", "=p", "=q"}
    for kind in ("language", "topic"):
        assert sum(r.goal for r in sides if r.kind == kind) == pytest.approx(1) and all(abs(r.goal - r.share) < 0.05 for r in sides if r.kind == kind)
    assert mixing.mix(docs.limit(0), target).count() == 0 and mixing.mix(docs, target.limit(0)).count() == 0


def test_many_cells_are_mixed_like_few(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randrange(5, 60)), rng.choice(["en", "de"]), rng.choice("ab"), f"p{i % 150}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, project string")
    target = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 3)], "source string, target_share double, max_repeats int")
    few = sorted(mixing.mix(docs, target).collect())
    for name, n in (("MAX_CELLS", 5), ("SMALL", 5), ("CHUNK", 97)):
        monkeypatch.setattr(mixing, name, n, raising=False)
    assert sorted(mixing.mix(docs, target).collect()) == few
    assert {r.value for r in mixing.marginals(docs, target).collect() if r.kind == "topic" and r.tokens} == {f"=p{i}" for i in range(150)}


def test_raking_in_chunks(monkeypatch):
    rng = np.random.default_rng(6)
    args = [rng.integers(0, k, 1000) for k in (3, 4, 90)] + [rng.integers(10, 90, 1000).astype(float), np.array([0.5, 0.5, 0.0]), np.array([1.0, 2.0, 4.0])]
    w, total = mixing.rake(*args)
    monkeypatch.setattr(mixing, "CHUNK", 7, raising=False)
    again, same = mixing.rake(*args)
    assert (w == again).all() and total == same and (w[args[0] == 2] == 0).all()
    assert np.allclose(np.bincount(args[0], w * args[3]) / total, args[4])
