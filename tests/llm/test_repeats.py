"""Repeat removal against brute force on small random corpora with copies, overlaps, nulls and hot groups."""

import hashlib
import random

import numpy as np
import pytest

from stackloom.llm import substring, suffix_dedup, winnow


def corpus(seed, n=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(30)]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(0, 60))) for _ in range(n)]
    shared = " ".join(rnd.choices(vocab, k=14))
    for i in range(0, n, 3):  # a passage in a third of all rows, its surroundings differ
        t = texts[i].split()
        at = rnd.randint(0, len(t))
        texts[i] = " ".join([*t[:at], shared, *t[at:]])
    texts[5] = texts[2]
    texts[7] = texts[2] + "\n\t" + texts[2]
    texts[9] = "a a a a a a a a a a a a a a a a a a a a a a a"
    texts[11] = texts[9]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(n, None), (n + 1, ""), (None, texts[2]), (None, "lonely"), (3, texts[3]), (3, texts[2])]


def removed_words(rows, size):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if d is not None and first[k] < d:
                gone[i : i + size] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed_bytes(rows, size):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size,most", [(1, 8, 2000), (2, 5, 2000), (3, 8, 2)])
def test_words(spark, monkeypatch, seed, size, most):
    rows = corpus(seed)
    frame = substring.frame
    monkeypatch.setattr(substring, "frame", lambda s: type(frame(s))(**{**frame(s).__dict__, "most": most, "shard": 300, "block": 3}))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 n_words", "'x' th", "2 gone")
    got = [tuple(r) for r in substring.remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == removed_words(rows, size)


@pytest.mark.parametrize("most,block", [(2000, 3), (1, 3), (1, 100)])
def test_words_repeated_in_their_document(spark, monkeypatch, most, block):
    rnd = random.Random(7)
    some = lambda k: [f"v{rnd.randrange(10**6)}" for _ in range(k)]
    passage, fill = some(14), some(12)
    period = (passage + fill) * 6
    # A passage once in a small document; later, with equal surroundings each time, in others, two of which share an id.
    texts = [(1, some(9) + passage + some(9)), (5, period), (5, some(3) + period[:90] + some(4)), (6, some(5) + period), (7, some(20))]
    rows = [(d, " ".join(t)) for d, t in texts] + [(5, " ".join(period))]
    frame = substring.frame
    monkeypatch.setattr(substring, "frame", lambda s: type(frame(s))(**{**frame(s).__dict__, "most": most, "block": block}))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in substring.remove_repeats(docs, 8).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == removed_words(rows, 8)
    assert {n for d, _, n, _ in got if d == 5} >= {6 * len(passage)}


@pytest.mark.parametrize("seed,size,most", [(1, 30, 2000), (2, 12, 2000), (3, 30, 2)])
def test_bytes(spark, monkeypatch, seed, size, most):
    rows = corpus(seed)
    frame = suffix_dedup.frame
    monkeypatch.setattr(suffix_dedup, "frame", lambda s: type(frame(s))(**{**frame(s).__dict__, "most": most, "shard": 3000, "block": 4}))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, size).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == removed_bytes(rows, size)


@pytest.mark.parametrize("most", [2000, 1])
def test_words_without_an_id(spark, monkeypatch, most):
    rnd = random.Random(8)
    some = lambda k: [f"v{rnd.randrange(10**6)}" for _ in range(k)]
    passage, alike = some(14), some(20)
    # The same passage in other surroundings each time, and copies of a text: rows without an id keep their words in all.
    texts = [(1, some(9) + passage + some(9)), (2, some(9) + passage), (None, some(9) + passage + some(9)), (None, (passage + some(5)) * 2), (4, alike), (None, alike)]
    rows = [(d, " ".join(t)) for d, t in texts]
    frame = substring.frame
    monkeypatch.setattr(substring, "frame", lambda s: type(frame(s))(**{**frame(s).__dict__, "most": most, "block": 3}))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in substring.remove_repeats(docs, 8).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == removed_words(rows, 8)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_merge_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        strings = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 25))) for _ in range(rnd.randint(1, 8))]
        size = rnd.randint(1, 6)
        seen = {}
        for s in strings:
            for i in range(len(s) - size + 1):
                seen[s[i : i + size]] = seen.get(s[i : i + size], 0) + 1
        cut = rnd.randint(0, len(strings))
        blocks = [b for b in (strings[:cut], strings[cut:]) if b]
        got = suffix_dedup.repeated(blocks, size)
        assert [g.tolist() for g in got] == [[seen[s[i : i + size]] > 1 for i in range(max(0, len(s) - size + 1))] for s in strings]


def test_blocks_of_copies_merge():
    """Copies within blocks and between them: one suffix a group goes into the merge, and the answers stay whole."""
    rnd = random.Random(10)
    for _ in range(40):
        some = [bytes(rnd.choices(b"abc", k=rnd.randint(0, 60))) for _ in range(4)]
        strings = [x[rnd.randint(0, 9) :] for x in rnd.choices(some, k=12)]
        size = rnd.choice([1, 2, 7, 16, 30])
        seen = {}
        for s in strings:
            for i in range(len(s) - size + 1):
                seen[s[i : i + size]] = seen.get(s[i : i + size], 0) + 1
        got = suffix_dedup.repeated([strings[:5], strings[5:6], strings[6:]], size)
        assert [g.tolist() for g in got] == [[seen[s[i : i + size]] > 1 for i in range(max(0, len(s) - size + 1))] for s in strings]


def test_structure_sees_what_contexts_share(spark, tmp_path):
    """A phrase too short to repeat costs no suffixes, wherever it stands; a passage that repeats between others does."""
    rnd = random.Random(11)
    some = lambda k: "".join(chr(rnd.randrange(97, 123)) for _ in range(k))
    phrase, passage = some(40), some(90)
    texts = [some(150) + phrase + some(150) for _ in range(8)] + [some(90) + passage + some(90) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as th", "text")
    rep = suffix_dedup.frame(60, 12)
    log, whole = str(tmp_path / "seen"), rep.resolve

    def resolve(segments):
        with open(log, "a") as f:
            f.writelines(f"{d}\n" for d, _ in segments)
        return whole(segments)

    spans = type(rep)(**{**rep.__dict__, "resolve": resolve}).spans(docs).collect()
    assert {int(x) for x in open(log)} == {8, 9, 10} == {r["doc_id"] for r in spans}
    hit = {r["doc_id"]: 0 for r in spans}
    for d, s in {(r["doc_id"], i) for r in spans for i in range(r["first"], r["last"] + 1)}:
        assert 90 <= s <= 90 + 30
        hit[d] += 1
    assert hit == {8: 31, 9: 31, 10: 31}


def test_automaton_matches():
    rnd = random.Random(6)
    for _ in range(60):
        known = [rnd.choices("ab", k=rnd.randint(0, 12)) for _ in range(3)]
        a = substring.SuffixAutomaton()
        for k in known:
            a.add(k)
        text = rnd.choices("abc", k=15)
        held = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)} | {()}
        assert a.matches(text) == [max(m for m in range(i + 2) if tuple(text[i + 1 - m : i + 1]) in held) for i in range(len(text))]


def test_structures_decide_everything(spark, monkeypatch):
    """Without what the structures find nothing goes, however plain the copies; wrong block arrays give wrong answers."""
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (2000, 1):
        for module, remove, n in ((substring, substring.remove_repeats, "n_removed"), (suffix_dedup, suffix_dedup.remove_repeats, "n_removed")):
            frame = module.frame(8)
            blind = type(frame)(**{**frame.__dict__, "most": most, "block": 3, "resolve": lambda segs: [np.zeros(len(b), bool) for _, b in segs]})
            with monkeypatch.context() as m:
                m.setattr(module, "frame", lambda s, blind=blind: blind)
                assert remove(docs, 8).agg({n: "sum"}).first()[0] == 0
    rnd = random.Random(6)
    strings = [bytes(rnd.choices(b"abc", k=30)) for _ in range(6)] * 2
    want = [g.tolist() for g in suffix_dedup.repeated([strings[:5], strings[5:]], 9)]
    assert all(all(g) for g in want)
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda flat: np.arange(len(flat)))
    assert [g.tolist() for g in suffix_dedup.repeated([strings[:5], strings[5:]], 9)] != want


def test_merged_common_prefixes():
    """The interleave is the suffix order, and common never exceeds the true common prefix nor misses one of size."""
    rnd = random.Random(7)
    for _ in range(40):
        blocks = [[bytes(rnd.choices(b"ab", k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 4))]
        flats = []
        for b in blocks:
            flat = np.frombuffer(b"\0".join([*b, b""]), np.uint8).astype(np.int64) + 1
            flat[np.cumsum([len(s) + 1 for s in b]) - 1] = 0
            flats.append(flat)
        orders = [suffix_dedup.suffix_array(f) for f in flats]
        size = rnd.choice([1, 3, 8, 13])
        interleave, interval, common = suffix_dedup.merged([suffix_dedup.transform(f, o) for f, o in zip(flats, orders)], size)
        seen = [0] * len(blocks)
        suffixes = []
        for b in interleave.tolist():
            at = int(orders[b][seen[b]])
            seen[b] += 1
            suffixes.append(bytes(x for x in (flats[b][at:] % 256).tolist()).split(b"\0")[0])
        cut = [s[:size] for s in suffixes]
        assert all(x <= y for x, y in zip(cut, cut[1:]))
        for i in range(1, len(cut)):
            true = next((k for k in range(size + 1) if k == min(len(suffixes[i - 1]), len(suffixes[i])) or k < size and suffixes[i - 1][k] != suffixes[i][k]), size)
            assert common[i] <= true and (interval[i] == interval[i - 1]) == (min(true, size) >= size), (common[i], true)


def test_repeated_rows_and_one_document(spark):
    """Rows alike in id and text, and a document that repeats itself, for bytes."""
    rnd = random.Random(9)
    some = "".join(chr(rnd.randrange(97, 123)) for _ in range(300))
    rows = [(1, some), (1, some), (2, some[40:140] + "-" + some[50:200]), (None, "q" * 90), (4, "xy" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, 30).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == removed_bytes(rows, 30)


def test_window_minima():
    """The rightmost of the smallest upper halves, alike for equal windows whatever stands around them."""
    r = np.random.default_rng(1)
    for n, width in ((1, 1), (5, 5), (40, 7), (300, 153), (900, 8), (9, 1)):
        key = r.integers(0, 1 << 63, n).astype(np.uint64) & np.uint64(0xFFFFFFFF000000FF)
        key[r.integers(0, n, n // 2)] = key[0] ^ np.uint64(1)
        got = winnow._rightmost_min(key, width).tolist()
        assert got == [min(range(i, i + width), key=lambda j: (int(key[j]) >> 32, -j)) for i in range(n - width + 1)]
        around = np.concatenate([r.integers(0, 1 << 63, 5_000).astype(np.uint64), key, key[::-1]])
        assert winnow._rightmost_min(around, width)[5_000 : 5_000 + len(got)].tolist() == [x + 5_000 for x in got]
