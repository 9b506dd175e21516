"""Suffix-array dedup, decontamination, language profiles, near-dedup, pipeline (operators 5, 6, 7, 10)."""

import hashlib
import importlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pathglass.llm import chosen_path, decontaminate, lang_profiles, suffix_dedup


def brute_removed(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def figures(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("length", [50, 24])
def test_repeats_equal_brute_force(spark, frame, prose, length):
    r = random.Random(8)
    shared = "".join(r.choice("abcé ") for _ in range(90))
    rows = [*prose, (None, prose[3][1]), (3, prose[9][1]), (3, shared), (900, shared), (900, shared), (-5, shared[20:75])]
    rows += [(700 + k, shared[k : k + 55] + str(k) + shared) for k in range(12)] + [(800 + k, "ab" * 100) for k in range(5)]
    assert figures(suffix_dedup.remove_repeats(frame(rows), length)) == brute_removed(rows, length)
    assert suffix_dedup.remove_repeats(frame([])).count() == 0


def test_long_texts_are_cut_into_overlapping_buffers(spark, monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(3000)) for _ in range(3)]
    texts.append(texts[0][500:2500] + texts[2][:700])
    parts = [t.encode() for t in texts]
    seen = [[] for _ in parts]
    for buffer, number, places, starts, ends in suffix_dedup.slices(parts, 50, 400):
        part, first, count, _ = suffix_dedup.stretches(buffer, starts, ends, 50)
        for p, f, c in zip(part, first, count, strict=True):
            seen[number[p]] += [places[p] + f - starts[p] + k for k in range(c)]
    assert all(sorted(s) == list(range(len(t) - 49)) for s, t in zip(seen, parts, strict=True))


def test_cleaned_text_and_extra_columns(spark, frame):
    passage = "this passage of more than fifty bytes stands in two documents é"
    rows = [(1, "first. " + passage), (2, "second. " + passage + " end"), (3, passage)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(rows)).collect()}
    # The passage includes the ". " before it.
    assert [got[k].text for k in (1, 2, 3)] == ["first. " + passage, "second end", ""]
    assert got[2].row == "x" and got[2].batch == "x" and got[2].lang == "en"


@pytest.mark.parametrize("length", [50, 24])
def test_longest_previous_factors(length):
    r = random.Random(14)
    texts = [bytes(r.choices(b"ab", k=3)) * 36 for _ in range(6)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([np.arange(108 - length + 1) + 108 * k for k in range(6)])
    docs = np.array([4, 1, 3, 3, 0, 9])[at // 108]
    whole = [bytes(data[i : i + length]) for i in at]
    want = [length * any(w == v and e < d for v, e in zip(whole, docs, strict=True)) for w, d in zip(whole, docs, strict=True)]
    assert suffix_dedup.longest_previous_factors(data, at, docs, length).tolist() == want and 0 < sum(want) < length * len(want)
    assert not len(suffix_dedup.longest_previous_factors(data[:0], at[:0], docs[:0], length))


def test_starts_of_a_bucket_are_sorted_in_parts():
    """Stretches around one passage, all at one anchor: equal to one sort, with a bounded amount of memory."""
    r = np.random.default_rng(4)
    n, length = 12_000, 50
    passage = r.integers(97, 123, length - 8)
    text = np.concatenate([r.integers(97, 99, (n, 34)), np.broadcast_to(passage, (n, length - 8))], axis=1).astype(np.uint8)
    at = (np.arange(n)[:, None] * text.shape[1] + np.arange(text.shape[1] - length + 1)).ravel()
    docs, data = at // text.shape[1], text.ravel()
    want = suffix_dedup.longest_previous_factors(data, at, docs, length, at_once=len(at))
    tracemalloc.start()
    got = suffix_dedup.longest_previous_factors(data, at, docs, length, at_once=len(at) // 10)
    peak = tracemalloc.get_traced_memory()[1] - 16 * len(data)  # text as words, and padded
    tracemalloc.stop()
    assert (got == want).all() and 0 < (want == length).sum() < len(want)
    assert peak < 60 * len(at)  # sorted at once: 117 bytes a start


def test_array_code_holds_little_beside_its_text():
    """An executor's two workers share its memory with Spark: starts take a few bytes each, text is cut a slice at a time."""
    r = np.random.default_rng(5)
    text = r.integers(97, 101, 3_000_000).astype(np.uint8)
    at = np.arange(len(text) - 50)
    tracemalloc.start()
    suffix_dedup.longest_previous_factors(text, at, at // 500, 50)
    factors = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    for buffer, _, _, starts, ends in suffix_dedup.slices([text.tobytes()], 50):
        suffix_dedup.stretches(buffer, starts, ends, 50)
    cut = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert factors < 20 * len(at)  # before: the text as words, an order and keys of 8 bytes a start, 34 bytes
    assert cut < 50 << 20  # before: 114 MB


def test_smaller_positions_equal_a_scan():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        docs, common = r.integers(0, 9, n), r.integers(20, 60, n)
        common[0] = 0
        want = []
        for i in range(n):
            k, least = i - 1, int(common[i])
            while k >= 0 and docs[k] >= docs[i]:
                least, k = min(least, int(common[k])), k - 1
            want.append(least if k >= 0 and least >= 25 else 0)
        assert suffix_dedup._reach(docs, common, 25).tolist() == want


@pytest.mark.parametrize("hot", [2, 9])
def test_hot_anchors_are_split_by_whole_strings(spark, frame, prose, hot):
    r = random.Random(18)
    shared = "".join(r.choice("abcdefg ") for _ in range(300))
    rows = [*prose, *((400 + k, f"{r.random()} before " + shared + f" behind {r.random()}") for k in range(30)), (399, shared[20:150])]
    assert figures(suffix_dedup.remove_repeats(frame(rows), hot=hot)) == brute_removed(rows, 50)


def test_tokens_of_unlike_sets_differ():
    """Sets without a common shingle meet in a node no more often than 32 bits allow; before, 65 times here, and with the square of their number."""
    r = np.random.default_rng(7)
    tokens = np.stack([chosen_path.signature(np.sort(r.integers(0, 1 << 64, 2_000, np.uint64))) for _ in range(3_000)])
    assert sum(len(tokens) - len(np.unique(tokens[:, k])) for k in range(chosen_path.PLACES)) < 5


def test_shingle_sets_equal_brute_force(monkeypatch):
    r = random.Random(2)
    texts = [b"", b" \t\n", b"one", b"a b", b"A\x0bB", b"a b c d E f\r\x0c", b"a\x85b a\x85b a\x85b a\x85b a\x85b a\x85b", "\u00c9 \u00e9 \u00c9 \u00e9 \u00c9 \u00e9 \u00c9".encode()]
    texts += [b"x" * n + b" y" for n in (7, 8, 9, 16, 17, 511, 512, 513, 3_000)]
    texts += [" ".join(r.choice(["a", "B", "b", "lengthy", "lengthier", "lengthiest one"]) for _ in range(r.randint(1, 60))).encode() for _ in range(200)]
    words = [t.lower().split() for t in texts]
    for size in (1, 5, 70):
        want = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in words]
        got = [set(x.tolist()) for x in chosen_path.shingle_sets(texts, size)]
        assert list(map(len, got)) == list(map(len, want))
        assert all(len(got[i] & got[k]) == len(want[i] & want[k]) for i in range(0, len(texts), 7) for k in range(len(texts)))
        monkeypatch.setattr(chosen_path, "SLICE", 100)
        assert [set(x.tolist()) for x in chosen_path.shingle_sets(iter(texts), size)] == got


def test_factors_that_agree_by_chance_are_not_shared():
    """Before, texts met that have no more than an anchor in common, all the more of them, the more text there is."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    anchors, met = 0, []
    for n in [24] * 100 + [50] * 100:
        run = letters(n)
        both = []
        for _ in range(2):
            buffer, _, _, starts, ends = next(suffix_dedup.slices([f"{letters(60)}{run}{letters(60)}".encode()]))
            _, _, _, _, bucket, tag = suffix_dedup.halves(buffer, starts, ends, 50, 7)
            both.append((set(zip(bucket.tolist(), tag.tolist(), strict=True)), set(suffix_dedup.stretches(buffer, starts, ends, 50)[3].tolist())))
        anchors += n == 24 and len(both[0][1] & both[1][1])
        met.append(len(both[0][0] & both[1][0]))
    assert not any(met[:100]) and all(met[100:]) and anchors > 20


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_copies_of_whole_texts_are_not_searched(spark, frame, monkeypatch, most):
    text = "a text that many documents hold, " * 3 + "and its end"
    rows = [*((k, text) for k in range(20)), (0, text), (5, text), (None, text), (30, text + "."), (31, "short"), (32, "short"), (3, "x" + text), (33, None)]
    searched = []
    monkeypatch.setattr(suffix_dedup, "COPIES", most)
    monkeypatch.setattr(suffix_dedup, "_lists", lambda found, *x, of=suffix_dedup._lists: (searched.append(found.count()), of(found, *x))[1])
    got = suffix_dedup.remove_repeats(frame(rows), keep_text=False)
    assert figures(got) == brute_removed(rows, 50)
    assert searched == [4 if most > 3 else 21]  # 24 rows of 50 bytes and more have an id, 20 are later copies


def brute_contamination(docs, items, window, percent):
    """The rule over every diagonal, without masks; equal items count once, under the smallest id."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    distinct = {}
    for i, t in items:
        if i is not None:
            w = tuple(words(t))
            distinct[w] = min(distinct.get(w, i), i)
    named = [(i, " ".join(w)) for w, i in distinct.items()]
    best = {}
    for d, t in docs:
        if d is not None:
            for row in brute_overlaps([(d, t)], named, window, percent):
                at = (row[4], -row[2], -row[3], row[5])
                best[row[:2]] = max(best.get(row[:2], at), at)
    return {(d, i, -b[1], -b[2], b[0], b[3]) for (d, i), b in best.items()}


def test_contamination_equals_brute_force(spark, frame):
    r = random.Random(11)
    words = ["".join(r.choice("aeiousrt") for _ in range(4)) for _ in range(200)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    items = [make(r.choice([9, 12, 30, 45])) for _ in range(12)]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(50, " ".join(items[2])), (None, "no id " * 9), (51, None), (52, ""), (53, "too short")]
    docs = [(k, " ".join(make(40))) for k in range(10)]
    for k, item in enumerate(items):
        changed = [w if (j + k) % 5 else "other" for j, w in enumerate(item)]
        docs += [(100 + k, " ".join(make(7) + item + make(9))), (200 + k, "A, " + "... ".join(changed)), (300 + k, " ".join(item[: len(item) // 2]))]
    docs += [(None, bench[2][1]), (7, bench[2][1]), (7, bench[2][1].upper()), (400, None), (401, ""), (402, bench[4][1] + " " + " ".join(make(5000)))]
    benchmark = spark.createDataFrame([(*b, "x") for b in bench], "item_id long, text string, seed string")
    got = decontaminate.contamination(frame(docs), benchmark)
    want = brute_contamination(docs, bench, decontaminate.WINDOW, decontaminate.SHARE_PERCENT)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {100 + k for k in range(12)} <= {w[0] for w in want} and not {k for k in range(10) if k != 7} & {w[0] for w in want}
    kept = decontaminate.drop_contaminated(frame(docs), benchmark)
    assert kept.columns == frame(docs).columns
    bad = {w[0] for w in brute_contamination([(k, t) for k, (_, t) in enumerate(docs)], [(k, t) for k, (_, t) in enumerate(bench)], decontaminate.WINDOW, decontaminate.SHARE_PERCENT)}
    assert Counter(x.doc_id for x in kept.collect()) == Counter(i for k, (i, _) in enumerate(docs) if k not in bad)
    assert decontaminate.contamination(frame([]), benchmark).count() == decontaminate.contamination(frame(docs), benchmark.limit(0)).count() == 0


def brute_overlaps(docs, items, window, percent):
    """The rule itself, over every diagonal, without masks."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in docs:
        w = words(t)
        for i, item in ((i, words(x)) for i, x in items):
            n, best = min(len(item), window), None
            for diagonal in range(-len(item) + 1, len(w)):
                for at in range(len(item) - n + 1):
                    same = sum(0 <= k + diagonal < len(w) and w[k + diagonal] == item[k] for k in range(at, at + n))
                    if same and 100 * same >= percent * n:
                        best = max(best or (-1,), (same, -(at + diagonal), -at, n))
            if best:
                out.add((d, i, -best[1], -best[2], best[0], best[3]))
    return out


def test_contamination_misses_no_substitution(spark, frame):
    r = random.Random(21)
    bench = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 14)] + [(30, " ".join(f"long{k}" for k in range(30)))]
    docs = []
    for i, t in bench:
        item = t.split()
        n = min(len(item), 13)
        lost = n - -(-n * 75 // 100)
        for gone in itertools.combinations(range(n), lost):
            text = [f"x{k}" if k in gone else w for k, w in enumerate(item[:n])]
            docs.append((len(docs), " ".join(text) if i < 14 else " ".join(["before"] * r.randint(0, 3) + text)))
    docs += [(len(docs) + k, " ".join(w if r.random() < 0.75 else "other" for w in r.choice(bench)[1].split())) for k in range(60)]
    docs.append((-1, "i4w0 i4w1 no no i2w1 i2w0 i13w0 i13w1 i13w2"))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = set(map(tuple, decontaminate.contamination(frame(docs), benchmark).collect()))
    want = brute_overlaps(docs, bench, decontaminate.WINDOW, decontaminate.SHARE_PERCENT)
    assert got == want
    assert len({w[0] for w in want}) >= 1_000 and -1 not in {w[0] for w in want}
    # Another window, whose patterns are too many to enumerate, and another share.
    for window, percent in ((26, 70), (8, 50)):
        few = docs[-60:]
        got = set(map(tuple, decontaminate.contamination(frame(few), benchmark, window, percent).collect()))
        assert got == brute_overlaps(few, bench, window, percent)


def test_language_profiles(spark):
    r = random.Random(12)
    sounds = {"aa": "aeiou rstln", "bb": "öüäß chtzn", "cc": "яожиу рстлн"}
    rows = [(k, "".join(r.choice(sounds[lang]) for _ in range(r.randint(40, 300))), lang, "x", "y") for k, lang in enumerate(list(sounds) * 60)]
    rows += [(1000, None, "aa", "x", "y"), (1001, "", "aa", "x", "y"), (1002, "123 ... 日", None, "x", "y"), (1003, "12 !?", "bb", "x", "y"), (None, rows[0][1], "aa", "x", "y"), (5, rows[1][1], None, "x", "y"), (5, rows[1][1], None, "x", "y"), (1004, "ß" + "üö" * 60_000, "bb", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")
    got = lang_profiles.identify(docs).collect()
    assert len(got) == len(rows)
    truth = dict((i, lang) for i, _, lang, *_ in rows)
    judged = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 180]
    assert judged and all(g.lang_pred == truth[g.doc_id] for g in judged if g.doc_id != 5)
    by_id = {g.doc_id: g for g in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1000, 1001, 1003))
    assert all(0 <= g.score <= 1 for g in got)
    empty = docs.limit(0)
    assert lang_profiles.identify(empty).count() == 0
    assert {g.lang_pred for g in lang_profiles.predict_languages(docs, {}).collect()} == {"und"}


def test_every_language_is_learned_and_the_nearest_wins(spark):
    r = random.Random(16)
    sounds = {f"l{k:03d}": "".join(chr(0x4E00 + 20 * k + j) for j in range(12)) for k in range(300)}
    rows = [(k, "".join(r.choice(sounds[lang]) for _ in range(60)), lang) for k, lang in enumerate([*sounds, *sounds, *["l000"] * 400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = lang_profiles.learn_profiles(docs, sample_rows=300)
    assert set(profiles) == set(sounds)
    got = {g.doc_id: g for g in lang_profiles.predict_languages(docs.filter("doc_id < 40"), profiles, pred_col="best").collect()}

    def grams(text):
        found = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            found.update(word)
            found.update(padded[k : k + 2] for k in range(len(padded) - 1))
            found.update(padded[k : k + 3] for k in range(len(padded) - 2))
        return found

    code = lambda g: {1: lambda: ord(g), 2: lambda: ord(g[0]) << 21 | ord(g[1]), 3: lambda: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])}[len(g)]()
    for i, text, lang in rows[:40]:
        own = [g for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], code(x[0])))][: lang_profiles.RANKS]
        place = {name: {c: k for k, c in enumerate(codes)} for name, codes in profiles.items()}
        apart = {name: sum(min(abs(p[code(g)] - k), lang_profiles.RANKS) if code(g) in p else lang_profiles.RANKS for k, g in enumerate(own)) for name, p in place.items()}
        best = min(apart, key=lambda name: (apart[name], name))
        assert got[i].best == best == lang and abs(got[i].score - (1 - apart[best] / (lang_profiles.RANKS * len(own)))) < 1e-12


def test_ranked_orders_ties_by_code():
    codes = lang_profiles.ranked("ab ab c", 100)
    counts = Counter(lang_profiles.ngram_codes("ab ab c").tolist())
    assert list(codes) == sorted(counts, key=lambda k: (-counts[k], k))
    assert not len(lang_profiles.ngram_codes("")) and not len(lang_profiles.ngram_codes("1 2"))


def brute_components(rows):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall((t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, c is None or c == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaf,levels", [(1000, 4), (6, 3), (2, 1)])
def test_components_equal_brute_force(spark, frame, prose, leaf, levels):
    r = random.Random(13)
    base = prose[11][1].split() * 3
    rows = list(prose)
    for k in range(30):  # a dense group of near copies, in chains
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"w{r.randrange(6)}"
        rows.append((300 + k, " ".join(w)))
    rows += [(400 + k, "copy of a copy of a copy") for k in range(9)] + [(None, prose[3][1]), (None, "alone without id"), (12, "again and again"), (12, prose[20][1])]
    got = chosen_path.near_duplicates(frame(rows), leaf=leaf, levels=levels)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == brute_components(rows)
    assert chosen_path.near_duplicates(frame([])).count() == 0


def test_estimates_spare_no_similar_pair():
    sets = [np.arange(20, dtype=np.uint64), np.arange(1, 21, dtype=np.uint64)]
    sigs = np.zeros((2, chosen_path.PLACES), np.uint32)
    sigs[1, 28:] = 1
    assert chosen_path.link_node(["a", "b"], sets, sigs, 75) == [("a", "b")]
    assert sum(math.comb(64, k) * 0.75**k * 0.25 ** (64 - k) for k in range(65) if k < (0.75 - chosen_path.SLACK) * 64) < 1e-9
    level = 1 - 0.25**chosen_path.BRANCHES
    assert (1 - 0.75 * level ** (chosen_path.LEVELS - 1)) ** chosen_path.TREES < 1e-6
    free = list(range(1, 30))
    assert all(len(set(chosen_path.places_below(k, 1, free)) & set(free)) == chosen_path.BRANCHES for k in range(50))


def test_first_trees_grow_below_large_roots(spark, frame):
    r = random.Random(31)
    shared = [f"common{k}" for k in range(120)]
    rows = []
    for k in range(30):  # pairs that share half of their words with all others
        own = [f"own{k}x{j}" for j in range(100)]
        rows += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + own[:-2] + ["last"]))]
    r.shuffle(rows)
    got = chosen_path.near_duplicates(frame(rows), trees=chosen_path.FIRST_TREES, leaf=4, levels=2)
    named = {x.doc_id: x.component_id for x in got.collect()}
    assert sum(named[2 * k] == named[2 * k + 1] == 2 * k for k in range(30)) >= 28


def test_a_component_among_other_sets_is_not_branched(spark, frame, monkeypatch):
    r = random.Random(10)
    make = lambda n: " ".join(str(r.randint(0, 10**9)) for _ in range(n))
    line, own = make(40), make(12).split()
    rows = [(k, f"{line} {' '.join(own[:k % 12] + ['x%d' % k] + own[k % 12 + 1 :])}") for k in range(60)]
    rows += [(100 + k, f"{line} {make(25)}") for k in range(60)]
    entries = []

    def pruned(leaves, *rest, of=chosen_path._pruned):
        entries.append(leaves.selectExpr("sum(size(members))").first()[0] or 0)
        return of(leaves, *rest)

    monkeypatch.setattr(chosen_path, "_pruned", pruned)
    got = chosen_path.near_duplicates(frame(rows), leaf=30)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == brute_components(rows)
    # A set is in one list of each tree at most.
    assert entries[-1] <= chosen_path.TREES * len(rows)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    assert dict(map(tuple, chosen_path.components(links).collect())) == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path, prose):
    pipeline = importlib.import_module("corpus_pipeline")
    items = [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(3)]
    rows = [*prose, (500, "A leak: " + items[1][1] + " and more."), (501, prose[3][1])]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    left = [(i, t) for i, t in left if (i, True) in {(r[0], r[3]) for r in brute_components(left)}]
    removed = {r[0]: r for r in brute_removed(left, 50)}
    left = [(i, t) for i, t in left if removed[i][2] == 0 or removed[i][2] < removed[i][1]]
    bad = {w[0] for w in brute_contamination(left, items, decontaminate.WINDOW, decontaminate.SHARE_PERCENT)}
    assert bad == {500}
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in left} - bad
    assert all(got[i].decoded_sha256 == removed[i][4] for i in got)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    again = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, spark.createDataFrame([(3, "one two three"), (4, "one two three"), (3, "x y z"), (1, "x y z"), (None, "x y z"), (None, "all alone"), (9, None)], "doc_id long, text string"), "").collect()]
    assert sorted(again, key=repr) == sorted([(3, "one two three"), (1, "x y z"), (None, "all alone"), (9, None)], key=repr)
    frame = frame.selectExpr("*", *(f"'x' as {c}" for c in ("pred", "PRED_SCORE", "n_bytes", "n_removed", "id", "text_hash", "one", "__one", "key")))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns
    assert 4 <= len(pipeline.STAGES) <= 5
