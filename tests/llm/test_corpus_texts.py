import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import leakage as L
from spanforge.llm import spam as X
from spanforge.llm.encoding import TOKENIZERS, VOCABULARY, Encoder, decode_documents, encode_documents, read_ranks, serialise

DOCS = "doc_id long, file_path string, text string, source string, item_id long, ids string"


def documents(spark, rows):
    return spark.createDataFrame([(i, p, t, s, 1, "x") for i, p, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(serialise(read_ranks(f"{TOKENIZERS}/{VOCABULARY}")))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    from spanforge.llm.encoding import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(f"{TOKENIZERS}/{VOCABULARY}"), special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "Hello  world\n\n\tx", "it's we'll I'D", "<|endoftext|>", "é漢字 🙂\u200d\u3000x", "a\x1cb\x85c\xa0d", "x" * 5000, "def f(a):\n    return a\r\n", "1234 5.6e7", "\ufeff\0\x7f"])
def test_encoding_equals_the_public_one(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and encoder.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and encoder.decode(ids) == text


def test_encode_documents(spark):
    rows = [(1, "a", None, "s"), (2, "b", "", "s"), (3, "c", "hello world", "s"), (3, "c", "hello world", "s")]
    got = sorted((r.doc_id, r.ids) for r in encode_documents(documents(spark, rows)).collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert encode_documents(documents(spark, rows).limit(0)).count() == 0
    back = decode_documents(encode_documents(documents(spark, rows)))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, ""), (2, ""), (3, "hello world"), (3, "hello world")]


def sentence(rnd, n):
    return [rnd.choice("alpha beta gamma delta river stone cloud field token shard lever panel ridge".split()) + str(rnd.randrange(400)) for _ in range(n)]


def test_leaks(spark):
    rnd = random.Random(4)
    items = {i: sentence(rnd, 60) for i in range(1, 7)}
    common = sentence(rnd, 20)
    items[6] = common + sentence(rnd, 40)
    noise = lambda: sentence(rnd, 80)
    quoted = "\n# ".join(" ".join(items[2][k : k + 9]) for k in range(0, 60, 9)).upper().replace(" ", "\u00a0 ")
    edited = [w if k % 17 else "changed" for k, w in enumerate(items[3])]
    shuffled = items[4][:]
    rnd.shuffle(shuffled)
    two = items[5][:16] + sentence(rnd, 12) + items[5][40:56]
    texts = {
        10: noise() + items[1] + noise(), 11: noise(), 12: quoted.split(" "), 13: noise() + edited, 14: shuffled, 15: noise() + two,
        16: noise() + common + noise(), 17: noise() + items[1][:22] + noise(), 18: noise() + items[1][10:42],
    }
    rows = [(i, "p", " ".join(t), "s") for i, t in texts.items()] + [(30 + i, "p", " ".join(noise() + common), "s") for i in range(20)] + [(99, "p", None, "s"), (98, "p", "", "s"), (10, "p", " ".join(texts[10]), "s")]
    many = [(9, "p", "so (Too\n# short), he said", "s"), (8, "p", "short too", "s")]
    bench = [(i, "  " + " ".join(w) + " \n", None) for i, w in items.items()] + [(7, None, None), (8, " ", None), (9, "too short", None), (1, "  " + " ".join(items[1]) + " \n", None)]
    b = spark.createDataFrame(bench, "item_id long, text string, doc_id long")
    want = {(10, 1), (12, 2), (13, 3), (15, 5), (18, 1), (9, 9)}
    rows += many
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(documents(spark, rows), b).collect()} == want
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(documents(spark, rows), b, part_words=100).collect()} == want
    assert L.find_leaks(documents(spark, rows).limit(0), b).count() == 0 == L.find_leaks(documents(spark, rows), b.limit(0)).count()


def test_prefix_loses_no_leak():
    """Against plain matching of every pair."""
    rnd = random.Random(5)
    h = L.Hasher()
    items = [sentence(rnd, 40) for _ in range(12)]
    docs = [sentence(rnd, 30) + it[a : a + n] + sentence(rnd, 30) for it in items for a, n in ((0, 40), (5, 25), (3, 12))]
    hashed = [h.hashes(" ".join(w)) for w in items]
    table = L.Items(list(range(12)), hashed).index()
    matcher = L.Matcher(table, np.ones(len(table.keys), int))
    for d in docs:
        doc = h.hashes(" ".join(d))
        plain = []
        for i, w in enumerate(hashed):
            pairs = [(a, b) for a, x in enumerate(L.shingles(w)) for b, y in enumerate(L.shingles(doc)) if x == y]
            if pairs and L.held(w, doc, *(np.array(c) for c in zip(*pairs))) >= 0.45 * len(w):
                plain.append(i)
        assert matcher.leaked(doc) == plain


@pytest.mark.parametrize("share", [0.5, 0.6, 1.0])
@pytest.mark.parametrize("step", [6, 7, 8])
def test_leaks_with_a_word_changed_now_and_then(step, share):
    """The rarest shingles are the changed ones' neighbours, so that a short prefix would miss."""
    rnd = random.Random(step)
    h = L.Hasher()
    item = sentence(rnd, 200)
    part = item[: int(200 * share)]
    doc = sentence(rnd, 50) + [f"other{k}" if k % step == step - 1 else w for k, w in enumerate(part)] + sentence(rnd, 50)
    table = L.Items([1], [h.hashes(" ".join(item))]).index()
    kept = np.isin(table.keys, L.shingles(h.hashes(" ".join(doc))))
    matcher = L.Matcher(table, np.where(kept, 1_000, 1))  # the order least fitting for the shared ones
    assert matcher.leaked(h.hashes(" ".join(doc))) == [0]


def test_pieces_far_apart_and_out_of_order():
    rnd = random.Random(9)
    h = L.Hasher()
    item = sentence(rnd, 60)
    table = L.Items([1], [h.hashes(" ".join(item))]).index()
    matcher = L.Matcher(table, np.ones(len(table.keys), int))
    far = sentence(rnd, 900)
    assert matcher.leaked(h.hashes(" ".join(item[:18] + far + item[30:48]))) == [0]
    assert matcher.leaked(h.hashes(" ".join(item[30:48] + far + item[:18]))) == []
    assert matcher.leaked(h.hashes(" ".join(item[:18] * 40))) == []


def prose(rnd, n):
    """n varied sentences."""
    noun = lambda: rnd.choice("lever panel gate river stone field pump tank cloud shard token parcel bridge".split())
    verb = lambda: rnd.choice("opens moves holds turns counts watches mends feeds follows".split())
    form = ["The {0} {1} every {2} when the {3} is high.", "Nobody {1} a {0} before the {2} of the {3} has come.", "If the {0} {1} one {2}, then the {3} waits for it.", "There is no {0} that {1} both the {2} and the {3}."]
    return " ".join(rnd.choice(form).format(noun(), verb(), noun(), noun()) for _ in range(n)) + " "


PROSE = prose(random.Random(7), 8)


def spam_pages():
    rnd = random.Random(6)
    tags = [f"gadget{i}" for i in range(8)]
    yield from (", ".join(rnd.choice(["buy", "best", "cheap"]) + " " + rnd.choice(tags) for _ in range(60)) for _ in range(20))
    yield from ("\n".join(f"- [{rnd.choice(tags)}](http://x{i}.example/{rnd.random()})" for i in range(25)) for _ in range(20))
    yield from (" ".join("#" + rnd.choice(tags) for _ in range(60)) for _ in range(20))


def good_pages():
    rnd = random.Random(8)
    yield from (prose(rnd, 4 + i % 20) for i in range(60))
    yield from ("# Index\n\n" + "".join(f"- item{j}: {prose(rnd, 1)}\n" for j in range(12)) for i in range(20))
    yield from ("# Figures\n\n| a | b |\n|---|---|\n" + "".join(f"| row{j} | {i * j} |\n" for j in range(30)) + "\n" + prose(rnd, 4) for i in range(20))
    yield from ("```python\n" + "x = 1; y = x\n" * 60 + "```\n" + prose(rnd, 3) for _ in range(20))


def measured(pages):
    found = [b for t in pages for b in X.blocks(t)[0]]
    return np.array([X.evidence(*b) for b in found]), np.array([X.features(b[0]) for b in found])


def test_spam_held_out():
    """Trees fitted on weak labels of half of the blocks, against what the rest was made as."""
    (be, bf), (ge, gf) = measured(spam_pages()), measured(good_pages())
    x, weak = np.concatenate([bf, gf]), X.weak_labels(np.concatenate([be, ge]))
    y = np.r_[np.ones(len(bf)), np.zeros(len(gf))]
    assert (weak[weak >= 0] == y[weak >= 0]).mean() > 0.98 and (weak >= 0).mean() > 0.8
    held = np.random.default_rng(3).random(len(x)) < 0.5  # not every other one: pages of two kinds of blocks alternate
    known = np.flatnonzero((weak >= 0) & ~held)
    forest = X.train(x[known], weak[known])
    assert ((forest.score(x[held]) >= 0.5) == y[held]).mean() > 0.97


def test_trees_decide_what_the_rules_leave_open():
    """Tags whose words are function words of no list, set apart by single hyphens: no rule
    knows them, trees fitted on other tags do."""
    rnd = random.Random(12)
    tags = [f"{a}{b}" for a in ("quarz", "lampe", "canard", "mesa") for b in ("pro", "lite", "plus")]
    ad = lambda: " - ".join(f"{rnd.choice(tags)} {rnd.choice(['pas cher', 'comprar ya', 'angebot', 'prix'])}" for _ in range(40))
    (be, bf), (ge, gf) = measured(spam_pages()), measured(good_pages())
    weak = X.weak_labels(np.concatenate([be, ge]))
    forest = X.train(np.concatenate([bf, gf])[weak >= 0], weak[weak >= 0])
    e, f = measured([ad() for _ in range(20)])
    assert (X.weak_labels(e) == -1).all() and (forest.score(f) >= 0.5).mean() > 0.9


def test_rules_abstain_when_they_contradict():
    e = dict.fromkeys(X.EVIDENCE, 0.0)
    row = lambda **k: np.array([[{**e, **k}[n] for n in X.EVIDENCE]])
    assert X.weak_labels(row(links=0.9, words=3)) == [1] and X.weak_labels(row(words=30, varied=0.9)) == [0]
    assert X.weak_labels(row(words=30, varied=0.3, figures=0.5)) == [-1] and X.weak_labels(row(words=30, varied=0.6, separators=0.15)) == [-1]


def test_repetition_in_scripts_without_blanks():
    prose = "昨日は雨が降ったので図書館で古い地図を調べた。川の流れは百年前とほとんど変わっていない。橋の名前だけが新しくなった。"
    spam = "格安時計、" * 30
    (p,), (s,) = measured([prose])[0], measured([spam])[0]
    assert X.weak_labels(np.array([p, s])).tolist() == [0, 1]


def test_host_rate_moves_a_page(spark):
    rows = [(i, f"{i}.md", t, "bad" if i < 40 else "good") for i, t in enumerate([*spam_pages(), *good_pages()])]
    got = {r.host: r for r in X.score_pages(documents(spark, rows)).groupBy("host").agg({"host_rate": "max", "score": "avg", "page_score": "avg"}).collect()}
    assert got["bad"]["max(host_rate)"] > got["good"]["max(host_rate)"]
    assert got["bad"]["avg(score)"] > got["bad"]["avg(page_score)"] and got["good"]["avg(score)"] < got["good"]["avg(page_score)"]


def test_find_spam(spark):
    rows = [(i, f"a{i}.md", t, f"h{i % 4}") for i, t in enumerate([*spam_pages(), *good_pages()])]
    n = len(list(spam_pages()))
    t = rows[0][2]
    rows += [(900, "x.md", None, None), (901, "x.md", " ", None), (902, "requirements-dev.txt", t, "h"), (903, "CMakeLists.txt", t, "h"), (904, "a.py", t, "h"), (905, "b.TXT", t, None), (906, None, t, "h"), (907, "z.md", prose(random.Random(9), 24) + "\n\n" + t[:80], "h1")]
    got = {r.doc_id for r in X.find_spam(documents(spark, rows)).collect()}
    assert got == set(range(n)) | {905}
    assert X.find_spam(documents(spark, rows).limit(0)).count() == 0


def test_long_text_features_are_quick_and_finite():
    assert np.isfinite(X.features("a" * 300_000)).all() and np.isfinite(X.features("word, " * 50_000)).all()
