"""The corpus operators against brute force, on fixtures with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tabulon.llm import byte_bpe, class_lm, code_search, language_id, license_scan, near_dup, packing, quality_rules, token_counts, warc_archive
from tabulon.llm.byte_level import encoder
from tabulon.llm.pieces import cut

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, word string, row bigint, digest string, n int, items int"


def _sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "Haus", "maison", "é", "run", "x1", "tree.", "and", "zu"]) + str(rng.randint(0, 40)) * rng.randint(0, 1) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = _sentence(rng, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", " \n\t ", "one", "a b c", base, base, near, base.upper(), "x" * 5000, _sentence(rng, 30000), "! ? #$%", "<|endoftext|> hi <|startoftext|>", "Released under the MIT License."]
    texts += [_sentence(rng, rng.randint(5, 200)) for _ in range(40)]
    out = [(k, t, ("en", "de", None)[k % 3], "s", 0, False, "w", 1, "d", 2, 3) for k, t in enumerate(texts)]
    return [*out, out[5], (None, "no id here at all", "en", "s", 0, True, "w", 1, "d", 2, 3), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return (t or "").encode().lower().split()


def test_quality_statistics_and_rules(spark, docs, empty, rows):
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0, True) for k in range(54)] + [(None, 1, 0, True), (3, None, 0, True)], "doc_id bigint, quality int, toxic int, kept boolean")
    rules = quality_rules.learn(docs, labels)
    got = quality_rules.judge(docs, rules, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = [False] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                marked[i] = marked[i + 1] = marked[i + 2] = True
        lines = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        symbols = sum(c in "#*$%&|<>" for c in r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), sum(marked))
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(marked) > 50 * len(w))
        x = np.array([[r[f] for f in quality_rules.FEATURES]])
        picked = any(quality_rules._matches(rule, x)[0] for rule in rules)
        assert r["kept"] == (not r["base_failed"] and not picked)
    assert rules
    assert quality_rules.judge(docs, rules, "doc_id").where("kept").count() == sum(r["kept"] for r in got)
    assert quality_rules.learn(empty, labels) == []
    assert quality_rules.judge(empty, [], "doc_id").count() == 0


def test_rule_learner_finds_a_threshold():
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality_rules.FEATURES)))
    bad = x[:, 2] > 0.7
    rules = quality_rules.learn_rules(x, bad, np.arange(300) % 3 == 2)
    hit = np.zeros(300, dtype=bool)
    for rule in rules:
        hit |= quality_rules._matches(rule, x)
    assert (hit == bad).mean() > 0.97


def test_language_profiles(spark, docs, empty, rows):
    text = {"en": "the house and the tree with them", "de": "der baum und das haus mit ihnen", "fr": "le maison avec les arbres et eux"}
    train = spark.createDataFrame([(k, v * 3, k, 1) for k, v in text.items()] + [("x", None, "en", 1), ("y", "abc", None, 1)], "doc_id string, text string, lang string, score int")
    profiles = language_id.learn(train)
    assert sorted(profiles) == ["de", "en", "fr"]
    assert all(r["lang_pred"] == r["lang"] for r in language_id.identify(train.where("lang is not null and text is not null"), profiles, "lang").collect())
    got = language_id.identify(docs, profiles, "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    few = language_id.learn(train, languages=2)
    assert len(few) == 2 and set(few) < {"de", "en", "fr"}
    assert language_id.learn(empty) == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}, "doc_id").collect()} == {"und"}
    assert language_id.identify(empty, profiles, "doc_id").count() == 0


def _grams(text):
    """1- to 3-grams of the words, padded by one boundary on each side, a boundary alone left out."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        out.update(word)
    code = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for n in (2, 3):
        for k in range(len(code) - n + 1):
            g = code[k : k + n]
            if (n == 2 and g.strip()) or (n == 3 and g[1] != " "):
                out[g] += 1
    return out


def test_language_distances_by_hand(spark, rows):
    """Profiles, ranks and out-of-place distances against strings and sorting."""
    number = lambda g: sum((0 if c == " " else ord(c)) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g)) | (1 << 42 if len(g) == 2 else 0)
    ranked = lambda c, size: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))][:size]
    texts = {"en": ["the house and the tree", "with them all, and more"], "de": ["der Baum und das Haus", "mit ihnen über Öl"]}
    train = spark.createDataFrame([(t, k) for k, v in texts.items() for t in v], "text string, lang string")
    learned = language_id.learn(train, size=30)
    profiles = {k: ranked(sum(map(_grams, v), Counter()), 30) for k, v in texts.items()}
    assert {k: v.tolist() for k, v in learned.items()} == {k: [number(g) for g in v] for k, v in profiles.items()}
    judge = language_id.Profiles(learned, 30).judge
    for text in ["the Öl house", "über the", "xyz", *[r[1] for r in rows[13:30]]]:
        own = ranked(_grams(text), 30)
        distance = {k: sum(abs(p.index(g) - i) if g in p else 30 for i, g in enumerate(own)) / (30 * len(own)) for k, p in profiles.items()}
        name, score, best = judge(text)
        low, high = sorted(distance.values())
        assert name == min(distance, key=lambda k: (distance[k], k)) and best == pytest.approx(low) and score == pytest.approx((high - low) / high)


def test_class_lm_counts(docs, empty, rows):
    got = class_lm.score(docs, docs.where("doc_id % 5 <> 1"), classes=6).collect()
    count = Counter()
    for r in rows:
        if r[0] is not None and r[0] % 5 != 1:
            count.update([*_words(r[1]), class_lm.END])
    total, distinct = sum(count.values()), len(count)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == total and r["score"] < 0
        if r["doc_id"] is not None:
            w = [*_words(by_id[r["doc_id"]]), class_lm.END]
            base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
            assert r["n_tokens"] == len(w) and r["n_known"] == sum(count[x] > 0 for x in w)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
    none = class_lm.score(docs, empty).collect()
    assert {r["n_known"] for r in none} == {0}
    assert class_lm.score(empty, docs).count() == 0


def test_exchange_splits_alternating_items():
    a = np.zeros((6, 6))
    a[:3, 3:] = a[3:, :3] = 10
    of = class_lm.exchange(a, 2)
    assert len(set(of[:3])) == 1 and len(set(of[3:])) == 1 and of[0] != of[3]


def test_class_lm_words_beyond_the_core(spark):
    # two kinds of words that share their ending: one stands after "left", one after "right"
    rng = random.Random(5)
    kinds = [[f"{k}{n}same" for n in range(700)] for k in "ab"]
    texts = [" ".join(f"left {rng.choice(kinds[0])} right {rng.choice(kinds[1])}" for _ in range(50)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = class_lm.choose_items(class_lm.word_counts(docs))
    model = class_lm.fit(docs, items, classes=4)
    of = {w: int(model.of[items.item[w.encode()]]) for k in kinds for w in k}
    assert len(of) > class_lm.WORD_ITEMS + class_lm.ENDING_ITEMS
    a, b = ({of[w] for w in k} for k in kinds)
    assert not a & b
    count = Counter(w for t in texts for w in t.split())
    # a word's probability is its own share of its class
    one, other = sorted(kinds[0], key=lambda w: count[w])[::699]
    if of[one] == of[other]:
        emit = [float(model.emit[items.item[w.encode()]]) for w in (one, other)]
        assert emit[1] - emit[0] == pytest.approx(math.log10((count[other] + 0.5) / (count[one] + 0.5)))


def test_best_classes_is_best_class():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 30, (6, 6)).astype(float)
    a, right, left = rng.integers(0, 6, 200), np.zeros((200, 6)), np.zeros((200, 6))
    for k in range(200):
        # an item's own places are among those of its class
        for _ in range(rng.integers(1, 5)):
            r, f = rng.integers(0, 6, 2)
            right[k, r] += 1
            left[k, f] += 1
    pairs += 10
    want = [class_lm.best_class(pairs.copy(), int(a[k]), right[k], left[k], 0.0) for k in range(200)]
    assert class_lm.best_classes(pairs, a, right, left).tolist() == want
    assert class_lm.best_classes(pairs, a[:0], right[:0], left[:0]).tolist() == []


def test_class_lm_rare_words_by_their_neighbours(spark, monkeypatch):
    # two kinds of words, too rare or too long for an item of their own, that share their ending
    monkeypatch.setattr(class_lm, "FREQUENT_SHARE", 20)
    rng = random.Random(5)
    kinds = [[f"{k}{n}{'x' * (n % 2 * 80)}same" for n in range(400)] for k in "ab"]
    some = lambda k: rng.choice(kinds[k]) if rng.random() < 0.4 else ("alpha", "beta")[k]
    texts = [" ".join(f"left {some(0)} right {some(1)}" for _ in range(50)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    items = class_lm.choose_items(class_lm.word_counts(docs))
    assert set(items.counts) == {class_lm.END, b"left", b"right", b"alpha", b"beta"}
    model = class_lm.fit(docs, items, classes=5)
    trained = set(" ".join(texts).split())
    a, b = ({int(model.of[items.item[w.encode()]]) for w in k if w in trained} for k in kinds)
    assert not a & b
    # a text that has them in each other's places is less likely
    one, other = (next(w for w in k if w in trained) for k in kinds)
    tests = spark.createDataFrame([(1, f"left {one} right {other}"), (2, f"left {other} right {one}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in class_lm.score(tests, docs, classes=5).collect()}
    assert got[1]["score"] > got[2]["score"] + 1
    assert got[1]["base_score"] == pytest.approx(got[2]["base_score"])


def test_class_lm_rare_classes_by_hand(docs, rows, monkeypatch):
    """The class of each rare word by the classes beside its places, with words that stand next to themselves, in small parts."""
    monkeypatch.setattr(class_lm, "FREQUENT_SHARE", 60)
    monkeypatch.setattr(class_lm, "TASK_WORDS", 500)
    monkeypatch.setattr(class_lm, "PASSED_ROWS", 7)
    monkeypatch.setattr(class_lm, "JUDGED_ROWS", 16)
    monkeypatch.setattr(class_lm, "KEPT_WORDS", 3)
    seen, made = [], class_lm.rare_classes
    monkeypatch.setattr(class_lm, "rare_classes", lambda *x: seen.append((x, made(*x))) or seen[0][1])
    training = docs.where("doc_id % 5 <> 1")
    items = class_lm.choose_items(class_lm.word_counts(training))
    class_lm.fit(training, items, classes=6)
    (_, _, own, by_ending, pairs), found = seen[0]
    found = {bytes(r["word"]): (r["n"], r["class"]) for r in found.collect()}
    texts = [[class_lm.END, *_words(r[1]), class_lm.END] for r in rows if r[0] is not None and r[0] % 5 != 1]
    start = lambda w: int(own[items.own[w]] if w in items.own else by_ending[items.endings.get(class_lm.ending(w), -1)])
    want = np.zeros((6, 6))
    beside = {}
    for t in texts:
        for x, y in zip(t, t[1:], strict=False):
            want[start(x), start(y)] += 1
        for x, w, y in zip(t, t[1:], t[2:], strict=False):
            if w not in items.own:
                right, left, self_ = beside.setdefault(w, (np.zeros(6), np.zeros(6), [0]))
                if y == w:
                    self_[0] += 1
                else:
                    right[start(y)] += 1
                if x != w:
                    left[start(x)] += 1
    assert (pairs == want).all() and set(found) == set(beside) and any(x[2][0] for x in beside.values())
    for w, (right, left, self_) in beside.items():
        best = class_lm.best_class(want.copy(), start(w), right, left, float(self_[0]))
        assert found[w] == (right.sum() + self_[0], best)
    # words beyond those that the driver holds are looked up
    for w in sorted(found)[:4]:
        assert items.item[w] == len(items.own) + found[w][1]


def test_class_lm_words_and_endings_beyond_the_core_by_hand(docs, rows, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT_SHARE", 60)
    monkeypatch.setattr(class_lm, "WORD_ITEMS", 3)
    monkeypatch.setattr(class_lm, "ENDING_ITEMS", 2)
    seen, made = [], class_lm.assign
    monkeypatch.setattr(class_lm, "assign", lambda *x: seen.append((x, made(*x))) or seen[0][1])
    training = docs.where("doc_id % 5 <> 1")
    items = class_lm.choose_items(class_lm.word_counts(training))
    class_lm.fit(training, items, classes=5)
    (_, _, start, by_ending, pairs), (of, of_endings) = seen[0]
    assert len(of) > items.base and len(of_endings) > items.core_endings + 1
    number = lambda w: items.own[w] if w in items.own else len(of) + items.endings.get(class_lm.ending(w), len(items.endings))
    first, beside = np.concatenate((start, by_ending)), {}
    for r in rows:
        if r[0] is not None and r[0] % 5 != 1:
            t = [number(w) for w in [class_lm.END, *_words(r[1]), class_lm.END]]
            for x, y in zip(t, t[1:], strict=False):
                if x == y:
                    beside.setdefault(x, np.zeros((3, 5)))[2, 0] += 1
                else:
                    beside.setdefault(x, np.zeros((3, 5)))[0, first[y]] += 1
                    beside.setdefault(y, np.zeros((3, 5)))[1, first[x]] += 1
    core = {*range(items.base), *range(len(of), len(of) + items.core_endings), len(first) - 1}
    for k, (right, left, own) in beside.items():
        best = first[k] if k in core else class_lm.best_class(pairs.astype(float), int(first[k]), right, left, own[0])
        assert np.concatenate((of, of_endings))[k] == best


@pytest.mark.parametrize("share", [1 << 18, 60])
def test_class_lm_score_by_hand(docs, rows, monkeypatch, share):
    """The score from the classes, by counting class pairs and words; with a small share many words are rare."""
    monkeypatch.setattr(class_lm, "FREQUENT_SHARE", share)
    training = docs.where("doc_id % 5 <> 1")
    items = class_lm.choose_items(class_lm.word_counts(training))
    model = class_lm.fit(training, items, classes=6)
    texts = [[*_words(r[1]), class_lm.END] for r in rows if r[0] is not None and r[0] % 5 != 1]
    item = lambda w: items.item[w]
    of = lambda w: int(model.of[item(w)])
    pairs, words, in_item = Counter(), Counter(), {}
    for t in texts:
        pairs.update(zip(map(of, [class_lm.END, *t]), map(of, t), strict=False))
        words.update(t)
    for w, n in words.items():
        in_item.setdefault(item(w), []).append(n)
    if share == 60:
        assert any(len(v) > 1 for v in in_item.values())
    used = len(set(model.of.tolist()))
    leave = Counter()
    for (a, _), n in pairs.items():
        leave[a] += n
    size = lambda k: sum(in_item.get(k, [0]))
    held = Counter()
    for k in range(len(items)):
        held[int(model.of[k])] += size(k) + 0.5

    def want(t):
        total = 0.0
        for a, w in zip([class_lm.END, *t], t, strict=False):
            total += math.log10((pairs[of(a), of(w)] + 0.5) / (leave[of(a)] + 0.5 * used)) + math.log10((size(item(w)) + 0.5) / held[of(w)])
            if w not in items.counts:
                total += math.log10((words[w] + 0.5) / (size(item(w)) + 0.5 * (len(in_item.get(item(w), [])) + 1)))
        return total

    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in class_lm.score(docs, training, classes=6).collect():
        if r["doc_id"] is not None:
            assert r["score"] == pytest.approx(want([*_words(by_id[r["doc_id"]]), class_lm.END]), rel=1e-9)


def _shuffled_rows(spark):
    """Rows that the session's stages have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_class_lm_moves_a_rare_word_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT_SHARE", 60)
    rng = random.Random(3)
    words = [f"{k}same" for k in range(300)] * 40
    rng.shuffle(words)
    docs = spark.createDataFrame([(k, " ".join(words[k::20])) for k in range(20)], "doc_id bigint, text string").coalesce(1)
    before, most = _shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = class_lm.score(docs, docs.where("doc_id < 15"), classes=6).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(got) == 20 and all(r["n_known"] == r["n_tokens"] == 601 for r in got)
    # the texts have 21,000 of them, as those trained on are texts of their own
    assert _shuffled_rows(spark) - before < 4000


@pytest.mark.parametrize("size", [0, 2000])
def test_class_lm_scores_do_not_depend_on_blocks(docs, monkeypatch, size):
    monkeypatch.setattr(class_lm, "FREQUENT_SHARE", 60)
    training = docs.where("doc_id % 3 = 1")
    scores = lambda: {(r["doc_id"], r["n_tokens"]): r for r in class_lm.score(docs, training, classes=6).collect()}
    want = scores()
    assert any(r["n_known"] < r["n_tokens"] for r in want.values())
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(class_lm, "TASK_NEIGHBOURS", 50)
    monkeypatch.setattr(class_lm, "PASSED_ROWS", 7)
    got = scores()
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r["n_known"] == want[k]["n_known"]
        assert r["base_score"] == pytest.approx(want[k]["base_score"], rel=1e-9) and r["score"] == pytest.approx(want[k]["score"], rel=1e-9)


def test_code_search(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.normal(size=64).tolist(), 1) for k in range(300)] + [(k, [1.0] * 64, 1) for k in range(300, 340)] + [(400, None, 1), (None, [1.0] * 64, 1), (401, [], 1)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, code int").where("embedding is not null and vec_id is not null")
    rows = frame.select("vec_id", code_search.sign_code(frame["embedding"]).alias("code"))
    found = code_search.search(rows, rows.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "code"), k=7).collect()
    code = {k: [x > 0 for x in v] + [False] * (64 - len(v)) for k, v, _ in vectors if v is not None and k is not None}
    for q in {r["query_id"] for r in found}:
        best = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), k) for k, c in code.items())[:7]
        assert [(r["distance"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best
    none = rows.where("false")
    assert code_search.search(none, none.selectExpr("vec_id AS query_id", "code")).count() == 0


def test_code_search_of_long_codes(spark):
    """Vectors of several words, of unlike lengths and with null elements."""
    rng = np.random.default_rng(6)
    vectors = [(k, [None if rng.random() < 0.02 else float(x) for x in rng.normal(size=rng.integers(100, 151))]) for k in range(120)]
    vectors += [(k, vectors[3][1]) for k in range(200, 215)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    words = code_search.words_of(frame, "embedding")
    assert words == 3
    rows = frame.select("vec_id", code_search.sign_code(frame["embedding"], words).alias("code"))
    found = code_search.search(rows, rows.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "code"), k=5).collect()
    code = {k: [x is not None and x > 0 for x in v] + [False] * (192 - len(v)) for k, v in vectors}
    for q in (0, 50, 100, 200):
        best = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), k) for k, c in code.items())[:5]
        assert [(r["distance"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best


def test_token_counts_forget_rare_words(docs, rows, monkeypatch):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    lengths = token_counts._Lengths(path, half=20)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    for r in rows:
        t = (r[1] or "").encode()
        assert sum(map(lengths.__getitem__, t.split())) == len(model.encode(r[1] or "", add_special_tokens=False))
        lengths.turn()
    assert len(lengths) <= 20 + 30_000


def test_token_counts(docs, empty, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    model = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, tokenizer=path, frequent=token_counts.broadcast_lengths(docs, path, 50), limit=100).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "", add_special_tokens=False)), n > 100) for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(empty, tokenizer=path, frequent=token_counts.broadcast_lengths(empty, path)).count() == 0


def test_byte_bpe(docs, empty, rows):
    path = public_tokenizers.path(byte_bpe.RANKS)
    encoding = byte_bpe._encoder(path)
    want = Counter()
    for r in rows:
        ids = encoding.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in byte_bpe.encode(docs, ranks=path, digests=True).collect()) == want
    whole = byte_bpe.encode(docs, ranks=path).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in whole) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.encode(empty, ranks=path).count() == 0


def test_blocks_split_by_size(docs, rows, monkeypatch):
    path = public_tokenizers.path(byte_bpe.RANKS)
    whole = Counter(tuple(r) for r in byte_bpe.encode(docs, ranks=path, digests=True).collect())
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(byte_bpe, "SEEN_WORDS", 10)
    assert Counter(tuple(r) for r in byte_bpe.encode(docs, ranks=path, digests=True, buckets=3).collect()) == whole


def test_decoding_joins_the_token_table(docs, empty, rows):
    path = public_tokenizers.path(byte_bpe.RANKS)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks=path), path).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in decoded) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.decode(byte_bpe.encode(empty, ranks=path), path).count() == 0


def test_cuts_never_cross_pre_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    model, fast = Tokenizer.from_file(path), encoder(path)
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", " \n", "é", "'s", "<|endoftext|>", "12", "!", "\t", "　", " the", "\x1c", "\x85", "日"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = model.encode(t, add_special_tokens=False).ids
        assert "".join(cut(t)) == t
        assert [i for e in model.encode_batch(cut(t), add_special_tokens=False) for i in e.ids] == ids
        assert np.frombuffer(fast(t), dtype="<u4").tolist() == ids
    assert len(fast(" " * 30000)) == 4 * 30000


def test_warc_archive(spark, tmp_path):
    long = "p" * 200 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(5, "u", long, 1), (3, "u\r\nX: y", long, 1), (3, "u\r\nX: y", long, 1), (9, None, long, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (None, "u", long, 1), (6, "é", "é" * 60, 1)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest int")
    warc_archive.write_archive(frame, str(tmp_path / "a"))
    got = warc_archive.read_archive(spark, str(tmp_path / "a")).collect()
    assert Counter((r["page_id"], bytes(r["payload"])) for r in got) == Counter((p[0], (p[2] or "").encode()) for p in pages)
    kind = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kind == {(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "response", None), (4, "response", None), (None, "response", None), (6, "response", None)}
    # every original record to the byte, from its header block and the payload of its digest
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    name = lambda page, d: f"tag:archive,2024:page/{'none' if page is None else page}/sha256/{d}"
    want = Counter()
    for page, url, html, _ in pages:
        body = (html or "").encode()
        d = hashlib.sha256(body).hexdigest()
        refers = 3 if page in (5, 9) else None
        lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", *([f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A').replace(' ', '%20')}"] if url is not None else [])]
        lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Record-ID: <{name(page, d)}>", f"WARC-Payload-Digest: sha256:{d}"]
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers, d)}>"] if refers else []
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if refers else len(body))}", "", ""]
        want[("\r\n".join(lines) + http).encode() + (b"" if refers else body) + b"\r\n\r\n"] += 1
    assert Counter(bytes(r["record"]) for r in warc_archive.original_records(spark, str(tmp_path / "a")).collect()) == want
    warc_archive.write_archive(frame.where("false"), str(tmp_path / "b"))
    assert warc_archive.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    pages = [(k, "u", f"{k} " + "x" * n) for k, n in enumerate([10] * 30 + [5000] * 10 + [90_000, 300_000])]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(1)
    warc_archive.write_archive(frame, str(tmp_path / "a"), file_bytes=64_000, file_records=16)
    sizes = [len(__import__("gzip").decompress(p.read_bytes())) for p in (tmp_path / "a" / "warc").glob("part-*")]
    assert len(sizes) >= 4 and sum(n > 64_000 for n in sizes) == 2  # only the two records that are larger themselves
    assert {r["page_id"]: r["payload_bytes"] for r in warc_archive.read_archive(spark, str(tmp_path / "a"), content=False).collect()} == {k: len(h) for k, _, h in pages}
    for low, high, n in warc_archive.size_classes(10**9, 1 << 28, 4096):
        assert high is None or high * n <= 2 * (1 << 28)


def test_warc_bad_digest_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "z" * 300)], "page_id bigint, url string, html string")
    warc_archive.write_archive(frame, str(tmp_path / "a"))
    import gzip

    path = next(p for p in (tmp_path / "a" / "warc").glob("part-*") if b"zzz" in gzip.decompress(p.read_bytes()))
    damaged = gzip.compress(gzip.decompress(path.read_bytes()).replace(b"zzz", b"zyz", 1))
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(damaged)
    with pytest.raises(Exception, match="does not have its digest"):
        warc_archive.read_payloads(spark, str(tmp_path / "a")).collect()


def test_warc_parser_rejects_damage():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc_archive.parse(record * 2)) == [({"Content-Length": "3"}, b"abc")] * 2
    with pytest.raises(ValueError):
        list(warc_archive.parse(record[:-6]))


def _license_copies(words, template):
    """Brute force: whether some window of 1.25 template lengths holds 80 % of its shingles."""
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    wanted, row = set(grams(template)), grams(words)
    wide = max(1, int(1.25 * len(wanted)))
    return any(100 * len(wanted & set(row[s : s + wide])) >= 80 * len(wanted) for s in range(max(1, len(row))))


def _license_words(t):
    return [w.decode() for w in license_scan._WORD.findall(t.lower().encode())]


def test_license_scan(spark, docs, empty):
    mit = license_scan.TEMPLATES[2][1]
    words = mit.split()
    edited = " ".join(words[:20] + ["EDITED"] + words[21:])
    texts = [(1, "x y z " * 50 + mit + " tail words here " * 9), (2, edited), (3, " ".join(words[:20])), (4, None), (5, ""), (6, "so " * 30 + "released under\nthe MIT license!")]
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(1, "MIT"), (2, "MIT"), (6, "MIT")} and len(got) == 3
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["start_word"] == 150 and first["end_word"] == 150 + len(_license_words(mit))
    assert {r["license"] for r in license_scan.scan_licenses(docs).collect()} == {"MIT"}
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_copies_one_after_the_other():
    templates = license_scan.Templates(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES:
        n = len(_license_words(text))
        for gap in ("", " and ", " some words that stand between two copies of it "):
            between = len(_license_words(gap))
            spans = [(m[1], m[2]) for m in templates.scan([(text + " " + gap + " " + text).encode()])[0] if m[0] == name]
            assert spans == [(0, n), (n + between, 2 * n + between)], (name, gap)
    full = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and "NONINFRINGEMENT" in t)
    assert [m[:3] for m in templates.scan([full.encode()])[0] if m[0] == "MIT"] == [("MIT", 0, len(_license_words(full)))]


def test_license_scan_against_brute_force():
    """Random texts with edited pieces of templates: what is found is what brute force finds."""
    rng = random.Random(9)
    templates = license_scan.Templates(license_scan.TEMPLATES)
    known = [(name, _license_words(t)) for name, t in license_scan.TEMPLATES if len(_license_words(t)) >= 5]
    found = wanted = wrong = 0
    for _ in range(150):
        name, words = known[rng.randrange(len(known))]
        cut = rng.choice([0, 0, 0, rng.randint(0, len(words) // 3)])
        piece = [("edit" + str(rng.randint(0, 99)) if rng.random() < rng.choice([0, 0.01, 0.02]) else w) for w in words[cut:]]
        text = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 80))] + piece + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 80))]
        got = {m[0] for m in templates.scan([" ".join(text).encode()])[0]}
        want = {n for n, t in known if _license_copies(text, t)}
        wrong += len(got - want)
        found, wanted = found + len(got & want), wanted + len(want)
    assert wrong == 0 and found >= 0.97 * wanted > 0


def _components(rows, size):
    sets = {}
    for r in rows:
        w = _words(r[1])
        if r[0] is not None:
            sets[r[0]] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_near_duplicates(docs, empty, rows):
    want = _components(rows, 4)
    got = near_dup.near_duplicates(docs, words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicate_hub_group(spark):
    """A group of edited copies of one text, some of them too far from all others."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    rows = [(k, " ".join("e" + str(rng.randint(0, 9)) if rng.random() < 0.002 * (k % 30) else w for w in base)) for k in range(120)]
    want = _components(rows, 5)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_long_near_copies_make_few_pairs(spark, monkeypatch):
    """Long texts, each edited on its own: all links are found from far fewer pairs than the group has."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(4000)]
    rows = []
    for k in range(48):
        share = 0.004 if k < 30 else 0.03  # the later ones are too far from each other, and from most
        rows.append((k, " ".join("e" + str(rng.randint(0, 9999)) if rng.random() < share else w for w in base)))
    verify, pairs = near_dup.verify, []
    monkeypatch.setattr(near_dup, "verify", lambda p, *a: (pairs.append(p.count()), verify(p, *a))[1])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _components(rows, 5)
    assert sum(pairs) < 48 * 47 / 2


def test_hot_bucket_of_several_groups(spark, monkeypatch):
    """One bucket with copies of three versions of a text and many edits too far from all others."""
    monkeypatch.setattr(near_dup, "band_hashes", lambda signature, *a: np.ones((len(signature), near_dup.BANDS), dtype=np.int64))
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 900)}" for _ in range(200)]
    edit = lambda words, share: ["e" + str(rng.randint(0, 10**6)) if rng.random() < share else w for w in words]
    versions = [base, edit(base, 0.12), edit(base, 0.12)]
    rows = [(k, " ".join(edit(versions[k % 3], 0.006))) for k in range(60)] + [(k, " ".join(edit(base, 0.2))) for k in range(60, 130)]
    verify, pairs = near_dup.verify, []
    monkeypatch.setattr(near_dup, "verify", lambda p, *a: (pairs.append(p.count()), verify(p, *a))[1])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = _components(rows, 5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) > 60
    assert sum(pairs) < 1000 < 130 * 129 / 2


def test_bitmaps_bound_differences(spark):
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 2**63, 6000).astype(np.uint64)
    sets = [np.sort(pool[a:b]) for a, b in ((0, 900), (100, 1100), (0, 5000), (10, 100), (0, 1024), (0, 3000))]
    maps = [near_dup.bitmap(s).view(np.int64).tolist() for s in sets]
    rows = spark.createDataFrame([(i, j, maps[i], maps[j]) for i in range(6) for j in range(6)], "i int, j int, x array<bigint>, y array<bigint>")
    for r in rows.select("i", "j", near_dup.differing(rows["x"], rows["y"]).alias("d")).collect():
        true = len(np.setxor1d(sets[r["i"]], sets[r["j"]]))
        assert r["d"] is None or r["d"] <= true
        assert r["i"] != r["j"] or r["d"] == 0
    assert len(near_dup.bitmap(sets[2])) * 64 >= 4 * 5000 > 64 * near_dup.BITMAP_WORDS


def test_intermediates_can_be_removed(spark, docs):
    import os

    from tabulon.llm import common

    kept = common.materialise(docs, "to-go")
    path = common._MADE[-1]
    assert kept.count() and os.path.isdir(path.removeprefix("file:"))
    common._MADE[:] = [path]
    assert common.remove_intermediates(spark) == 1 and not os.path.isdir(path.removeprefix("file:"))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 2**63, 1500).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])
    s = near_dup.signatures([a, b, a[:3], np.empty(0, dtype=np.uint64)], 252)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12
    assert (s[2] != near_dup._FULL).all() and (s[3] == near_dup._FULL).all()


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (700, 650)]
    got = near_dup.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(8)).collect()
    assert {r["node"]: r["root"] for r in got} == {k: 0 for k in range(1, 201)} | {501: 500, 700: 650}


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs, capacity=256).collect()
    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = lambda t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
    want = Counter()
    for r in rows:
        a = ids(r[1])
        for k, (s, n) in enumerate(packing.spans(len(a), 256)):
            want[(r[0], k, s, n, zlib.crc32(a[s : s + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in placed.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(placed) <= -(-total // 256) + 1
    assert packing.pack_documents(empty).count() == 0


def test_long_texts_are_encoded_as_the_library_does():
    """Beyond PART_CHARS a text is encoded in parts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    model, fast = Tokenizer.from_file(path), encoder(path)
    rng = random.Random(8)
    for joint in (" ", "\n", "  ", "<|endoftext|> "):
        text = joint.join(_sentence(rng, 60) for _ in range(1200))
        assert len(text) > 200_000
        assert np.frombuffer(fast(text), dtype="<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_fullest_combination():
    for seed in range(50):
        rng = random.Random(seed)
        counts = Counter(rng.randint(1, 40) for _ in range(8))
        items = list(counts.elements())
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 60}
        picked = packing._fullest(dict(counts), sorted(counts, reverse=True), 60)
        assert sum(k * n for k, n in picked.items()) == max(sums) and all(n <= counts[k] for k, n in picked.items())
